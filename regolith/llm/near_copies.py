"""Components of near copies by shingle Jaccard similarity: SimHash links first, verified on the texts, then an exact way for the rest.

Every set of shingles has a SimHash. Sets whose fingerprints are equal or linked within RADIUS bits by
BK-trees are compared as text, and the links that reach the similarity make components. Near copies lie
further apart than any radius that a tree can prune, so no radius is complete; prefix-filtered candidates
are, and those that the SimHash links leave in different components are compared as well.

All shingles have one global order, those that a sample finds frequent last. Two documents whose sets
of n and m shingles have a Jaccard similarity of t or more share at least ceil(t n) of the first's, so
they share one of its n - ceil(t n) + 1 first shingles in that order, and likewise of the second's: no
pair is missed, whatever the sample. Pairs that meet there, can reach t by their sizes and the positions
of the shingle, and whose sketches (the parities of the shingles in 512 cells, then, of large sets, in about as
many cells as they have shingles) are not too far apart, are compared as text.

A large group of near copies does not give all its pairs. Where more than SHORT texts share a first
shingle, they are compared with a few leaders alone; only texts that are still in different components
afterwards are compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import first_rows, row_key, written
from regolith.llm.components import connected_components
from regolith.llm.hamming import hamming_links, simhash
from regolith.llm.wordstream import Words, chunks, span_hashes

WORDS = 5
#: Least Jaccard similarity of near copies, as a fraction of integers.
SIMILARITY = (4, 5)
#: Bits between the fingerprints that SimHash links.
RADIUS = 7
#: Most texts that share a first shingle and are all compared at once, and the leaders of more.
SHORT, LEADERS = 24, 3
#: Cells of a sketch, as 64-bit words.
SKETCH = 8
#: Documents whose shingles are counted for the order (or one in so many, if more), the count from which one is frequent, and the most kept.
ORDER_SAMPLE, ORDER_SHARE, FREQUENT, MOST_FREQUENT = 20_000, 12, 4, 500_000


def shingle_set(text: str | None, words: int = WORDS) -> set[str]:
    """Distinct runs of words of the lower-cased text; a text of fewer words is one shingle, one without words has none."""
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def _hash_sets(texts: list[bytes], words: int):
    """The distinct shingle hashes of each text, ascending."""
    found = Words([" ".join(t.decode().lower().split()).encode() for t in texts])
    hashes = found.hashes()
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        starts = np.arange(a, max(b - words + 1, a + 1) if b > a else a)
        yield np.unique(span_hashes(hashes[a:b], starts - a, np.minimum(starts + words, b) - a)) if b > a else np.zeros(0, np.uint64)


def _frequent(documents: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that a sample of the documents finds most often.

    A sample that did not grow with the documents would miss ever more shingles of long lists.
    """
    total = documents.count()
    sample = max(ORDER_SAMPLE, total // ORDER_SHARE)

    def run(batches):
        for rows in chunks(batches):
            for h in _hash_sets([t for (t,) in rows], words):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["hash"])

    text = F.coalesce(F.col("text"), F.lit(""))
    some = documents.where(F.pmod(F.xxhash64(text, F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / max(total, 1)))).select(text.cast("binary").alias("data"))
    counts = some.mapInArrow(run, "hash long").groupBy("hash").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "hash").limit(MOST_FREQUENT).toArrow()
    hashes, n = top["hash"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 64 * SKETCH cells: sets differ in as many members at least as sketches in bits."""
    cells = np.bincount((h >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _wide(h: np.ndarray) -> bytes:
    """The parities of a set too large for _sketch, in a power of two of cells of six tenths of its members at least; of others none."""
    if len(h) <= 64 * SKETCH:
        return b""
    cells = 1 << int(np.ceil(np.log2(0.6 * len(h) + 64 * SKETCH)))
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _wide_differ(a: bytes, b: bytes) -> int:
    """Cells in which the sketches differ, the longer one folded to the shorter one's cells; 0 where either is none."""
    if not a or not b:
        return 0
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_SKETCH = [f"s{i}" for i in range(SKETCH)]


def prefixes(documents: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """id, row_key, cls (a hash of the set of shingles), n, fp (the set's signed SimHash), prefix (first shingle hashes in the global order) and sketches of every row."""
    often, counts = _frequent(documents, words)
    over, under = similarity

    def first(h):
        keep = len(h) - -(-over * len(h) // under) + 1
        if len(often):
            at = np.minimum(np.searchsorted(often, h), len(often) - 1)
            h = h[np.argsort(np.where(often[at] == h, counts[at], 0), kind="stable")]
        return h[:keep].view(np.int64)

    def run(batches):
        for rows in chunks(batches):
            sets = list(_hash_sets([r[-1] for r in rows], words))
            cls = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64)
            fp = np.array([simhash(h) for h in sets], dtype=np.uint64).view(np.int64)
            sketches = np.array([_sketch(h) for h in sets], dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(cls), pa.array([len(h) for h in sets], pa.int32()), pa.array(fp),
                    pa.array([first(h) for h in sets], pa.list_(pa.int64())), pa.array([_wide(h) for h in sets], pa.binary()), *(pa.array(sketches[:, i]) for i in range(SKETCH)),
                ],
                names=["id", "row_key", "cls", "n", "fp", "prefix", "wide", *_SKETCH],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return documents.select(ident.alias("id"), row_key().alias("row_key"), text.cast("binary").alias("data")).mapInArrow(
        run, f"id long, row_key long, cls long, n int, fp long, prefix array<long>, wide binary, {', '.join(f'{c} long' for c in _SKETCH)}"
    )


def simhash_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Candidate pairs a < b of classes by their fingerprints: a class and the first of its fingerprint, the firsts of linked fingerprints.

    Links are those of hamming_links, a spanning forest of each shard, so that a large group does not give all its pairs.
    """
    firsts = written(classes.groupBy("fp").agg(F.min("cls").alias("first")), "firsts")
    found = written(hamming_links(firsts.select("fp"), radius), "simhash")
    same = classes.join(firsts, "fp").select(F.col("first").alias("x"), F.col("cls").alias("y")).where("x <> y")
    x, y = (firsts.select(F.col("fp").alias(side), F.col("first").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    linked = found.join(x, "a").join(y, "b").select("x", "y")
    return same.unionAll(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def apart(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs that the links so far leave in different components."""
    root = connected_components(near)
    x, y = (root.select(F.col("node").alias(side), F.col("root").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _possible(n, m, i, j, similarity: tuple[int, int]):
    """Whether sets of n and m shingles that share their i-th and j-th, and none before, can reach the similarity (arrays or columns)."""
    over, under = similarity
    least, greatest = (np.minimum, np.maximum) if isinstance(n, np.ndarray) else (F.least, F.greatest)
    left = least(n - i, m - j)  # most shingles shared from here on
    return (under * least(n, m) >= over * greatest(n, m)) & ((over + under) * left >= over * (n + m))


def _meet(batches, similarity: tuple[int, int], short: int, leaders: int, rows: int = 1 << 18):
    """Rows sorted by hash, at, n, cls -> pairs (a, b) with no hash, and again the postings of long lists with their hash."""
    schema = ["hash", "a", "b", "n", "at"]

    def out(hash_, a, b, n, at):
        return pa.RecordBatch.from_arrays([pa.array(hash_, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32())], names=schema)

    def pairs(a, b):
        none = [None] * len(a)
        return out(none, np.minimum(a, b), np.maximum(a, b), none, none)

    def lists(hash_, at, n, cls):
        """Complete lists: all pairs of short ones, pairs with the leaders of long ones."""
        new = np.flatnonzero(np.concatenate(([True], hash_[1:] != hash_[:-1])))
        size = np.diff(np.append(new, len(hash_)))
        group = np.repeat(np.arange(len(new)), size)
        some = np.flatnonzero((size[group] > 1) & (size[group] <= short))
        for k in range(1, short):
            x, y = some[:-k], some[k:]
            x, y = (v[group[x] == group[y]] for v in (x, y))
            if not len(x):
                break
            near = _possible(n[x], n[y], at[x], at[y], similarity)
            if near.any():
                yield pairs(cls[x[near]], cls[y[near]])
        for g in np.flatnonzero(size > short).tolist():
            part = slice(new[g], new[g] + size[g])
            yield from long(hash_[part], at[part], n[part], cls[part], [c[part][:leaders] for c in (at, n, cls)])

    def long(hash_, at, n, cls, first):
        for i, m, leader in zip(*first, strict=True):
            near = _possible(n, np.full(len(n), m), at, np.full(len(n), i), similarity) & (cls != leader)
            if near.any():
                yield pairs(cls[near], np.full(near.sum(), leader))
        yield out(hash_, cls, [None] * len(cls), n, at)

    held = [np.zeros(0, np.int64)] * 4
    going = None  # hash and leaders of a long list of which a part has been given out

    def flush(final: bool):
        nonlocal held, going
        if going is not None:
            end = int(np.searchsorted(held[0], going[0], "right"))
            if end:
                yield from long(*[c[:end] for c in held], going[1])
                held = [c[end:] for c in held]
            if not len(held[0]):
                return
            going = None
        cut = len(held[0]) if final else int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield from lists(*[c[:cut] for c in held])
            held = [c[cut:] for c in held]
        elif len(held[0]):
            going = int(held[0][0]), [c[:leaders] for c in held[1:]]
            yield from long(*held, going[1])
            held = [c[:0] for c in held]

    for batch in batches:
        held = [np.concatenate((c, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64))) for k, c in enumerate(held)]
        if len(held[0]) >= rows:
            yield from flush(False)
    yield from flush(True)


def meetings(classes: DataFrame, similarity: tuple[int, int] = SIMILARITY, short: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs a < b of classes that share a first shingle, and the postings (hash, cls, n, at) of long lists.

    Postings are dealt by their shingle and sorted once; a long list streams through its task.
    """
    short = SHORT if short is None else short
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    postings = classes.select("cls", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("at", "hash")).select("hash", F.col("at").cast("long").alias("at"), "n", "cls")
    dealt = postings.repartition(parts, "hash").sortWithinPartitions("hash", "at", "n", "cls")
    met = written(dealt.mapInArrow(lambda batches: _meet(batches, similarity, short, LEADERS), "hash long, a long, b long, n int, at int"), "meetings")
    return met.where(F.col("hash").isNull()).select("a", "b").distinct(), met.where(F.col("hash").isNotNull()).select("hash", F.col("a").alias("cls"), "n", "at")


def _close(x: str, y: str, similarity: tuple[int, int]):
    """Whether the sketches of the aliases x and y allow the similarity."""
    over, under = similarity
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _SKETCH), F.lit(0))
    return (over + under) * differ <= (under - over) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _alike(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs a, b whose wide sketches allow the similarity: far fewer bytes than the long texts that they keep from being moved."""
    over, under = similarity

    def run(batches):
        for batch in batches:
            a, b, n, x, y = batch.columns
            near = [(over + under) * _wide_differ(p, q) <= (under - over) * k for k, p, q in zip(n.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    wide = classes.where(F.length("wide") > 0)
    x, y = (wide.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    return both.select("a", "b", n, "wide_a", "wide_b").mapInArrow(run, "a long, b long")


def still_apart(long_lists: DataFrame, facts: DataFrame, near: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Candidate pairs of long lists that the links so far leave in different components; facts(cls, n, sketch)."""
    component = connected_components(near).select(F.col("node").alias("cls"), "root")
    wanted = long_lists.select("cls").distinct()
    of_class = written(facts.join(wanted, "cls", "left_semi").join(component, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "roots")
    placed = written(long_lists.drop("n").join(of_class, "cls"), "placed")
    mixed = written(placed.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hash"), "mixed")
    rest = written(placed.join(mixed, "hash", "left_semi"), "mixedlists")
    x, y = rest.alias("x"), rest.alias("y")
    c = F.col
    apart = (c("x.hash") == c("y.hash")) & (c("x.cls") < c("y.cls")) & (c("x.root") != c("y.root"))
    able = _possible(c("x.n"), c("y.n"), c("x.at"), c("y.at"), similarity) & _close("x", "y", similarity)
    return x.join(y, apart & able).select(c("x.cls").alias("a"), c("y.cls").alias("b")).distinct()


def verified(pairs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs a, b whose texts text_a, text_b reach the similarity."""
    over, under = similarity

    def run(batches):
        for batch in batches:
            a, b, s, t = batch.columns
            near = []
            for x, y in zip(s.to_pylist(), t.to_pylist(), strict=True):
                p, q = shingle_set(x, words), shingle_set(y, words)
                near.append(under * len(p & q) >= over * len(p | q))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def links(documents: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (id, row_key, cls) and links (a, b) of different classes of at least the similarity, whose components are those of all such links."""
    rows = written(prefixes(documents, words, similarity), "prefixes")
    least = rows.groupBy("cls").agg(F.min(F.struct("id", "row_key", "n", "fp", "prefix", "wide", *_SKETCH)).alias("r"))
    classes = written(least.select("cls", *(F.col(f"r.{c}").alias(c) for c in ("id", "row_key", "n", "fp", "prefix", "wide", *_SKETCH))), "classes")
    facts = classes.select("cls", "n", *_SKETCH)

    def compared(pairs, near=None):
        both = pairs.join(facts.alias("x"), F.col("a") == F.col("x.cls")).join(facts.alias("y"), F.col("b") == F.col("y.cls")).where(_close("x", "y", similarity)).select("a", "b")
        both = written(_alike(written(both if near is None else apart(both, near), "close"), classes, similarity), "alike")
        wanted = both.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        names = written(classes.select("cls", "id", "row_key").join(wanted, "cls", "left_semi"), "wanted")
        keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), row_key().alias("row_key"), "text")
        texts = written(keyed.join(names, ["id", "row_key"]).dropDuplicates(["cls"]).select("cls", "text"), "texts")
        met = both.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        return written(verified(met, words, similarity), "links")

    near = compared(simhash_pairs(classes))
    pairs, long_lists = meetings(classes, similarity)
    near = near.unionAll(compared(pairs, near))
    if not long_lists.isEmpty():
        near = near.unionAll(compared(still_apart(long_lists, facts, near, similarity)))
    return rows.select("id", "row_key", "cls"), near


def keep_one(documents: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents with one row kept of each component of near copies: that of the smallest doc_id.

    Texts with equal sets of shingles, and so all texts without words, are near copies. Of rows that repeat
    the doc_id the one with the smallest text hash stays; of full repeats, one. Any further columns stay.
    """
    rows, near = links(documents, words, similarity)
    member = connected_components(near)
    rooted = rows.join(member.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = rooted.groupBy("root").agg(F.min(F.struct("id", "row_key")).alias("first"))
    return first_rows(documents, written(firsts.select("first.id", "first.row_key").distinct(), "firsts"))
