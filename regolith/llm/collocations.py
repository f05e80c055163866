"""Phrase collocations by direct-address tiling of ranked pairs.

Texts become sequences of word codes in chunks of one language. Frequent words get ids by rank of their frequency;
neighbouring ids are pairs, and pairs fall into tiles of TILE x TILE ids. A tile with many occurrences is counted in
a dense array by bincount, the others as sorted coordinates. Tiles of all chunks meet in buckets and are added
up the same way. Frequent pairs are ranked in turn and take their words' places in the sequences: two neighbouring
pairs, which share a word, are a phrase of three words, and so on up to LONGEST. A phrase is frequent only if
its first and its last words are, so no phrase is missed.

What a chunk must know of a bucket (the ids of its frequent pairs) comes back to it by number; neither words nor
pairs are ever gathered whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regolith.llm.common import written
from regolith.llm.runs import Numbers, bucket_count, deltas, narrow, pack, text_bytes, unpack
from regolith.llm.wordstream import mix, span_hashes

FREQUENT = 100
LONGEST = 5
FIRST = 2_000
#: Side of a tile, and occurrences in it from which it is counted densely.
TILE_BITS = 10
DENSE = 1 << 16
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
#: Runs of a bucket in one task; more are added up in parts first, and answered in parts.
RUNS_PER_TASK = 2_000

#: What ends a piece, and what stands between words.
_CUTS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CUT = np.zeros(256, bool)
_CUT[list(_CUTS)] = True
_WORD = ~_CUT
_WORD[list(_GAPS)] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sequence(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, int]:
    """Word codes with -1 between pieces, the words of the codes, and the number of words."""
    data = b"\n".join(texts).translate(_LOWER)
    buf = np.frombuffer(data, np.uint8)
    inside = _WORD[buf]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges[: len(buf) + 1] == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    piece = np.cumsum(_CUT[buf], dtype=np.int32)[starts]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, -1), coded.dictionary, len(codes)


def pair_keys(seq: np.ndarray) -> np.ndarray:
    """For every place the pair of ids that begins there in one number, or -1."""
    a, b = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), (a << 32) | b, -1)


def tile_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 32 >> TILE_BITS) << 32) | ((keys & 0xFFFFFFFF) >> TILE_BITS)


def tile_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order and their counts (added up, if given), tile by tile dense or sorted."""
    tiles = tile_of(keys)
    names, sizes = np.unique(tiles, return_counts=True)
    low, out = (1 << TILE_BITS) - 1, []
    for tile in names[sizes >= DENSE].tolist():
        here = tiles == tile
        k = keys[here]
        cell = ((k >> 32 & low) << TILE_BITS) | (k & low)
        total = np.bincount(cell, None if counts is None else counts[here], 1 << 2 * TILE_BITS)  # exact below 2 ** 53
        some = np.flatnonzero(total)
        out.append(((((tile >> 32 << TILE_BITS) + (some >> TILE_BITS)) << 32) | ((tile & 0xFFFFFFFF) << TILE_BITS) + (some & low), total[some].astype(np.int64)))
    sparse = ~np.isin(tiles, names[sizes >= DENSE])
    order = np.argsort(keys[sparse], kind="stable")
    k = keys[sparse][order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    out.append((k[first], np.diff(np.append(first, len(k))) if counts is None else np.add.reduceat(counts[sparse][order], first) if len(k) else k))
    k, n = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(k)
    return k[order], n[order]


_ROWS = "lang string, bucket int, chunk long, n_words long, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, bucket, chunk, n, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())],
        names=["lang", "bucket", "chunk", "n_words", "body"],
    )


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 64):
        yield _batch(rows[k : k + 64])


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(order, at[1:]), strict=True):
        yield name, part


def _word_rows(lang: str, chunk: int, texts: list[bytes], buckets: int) -> list[tuple]:
    """The chunk's codes (bucket -1), and its words with their counts for the buckets."""
    seq, words, n = sequence(texts)
    rows = [(lang, -1, chunk, n, pack(seq))]
    if n:
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64, len(words) + 1)
        bucket = (span_hashes(np.frombuffer(data, np.uint8, int(ends[-1])), ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
        counts, spelled = np.bincount(seq[seq >= 0], minlength=len(words)), words.to_pylist()
        for b, of in _split(bucket):
            rows.append((lang, b, chunk, None, pack(narrow(of), narrow(counts[of]), np.frombuffer(b" ".join([spelled[i] for i in of.tolist()]), np.uint8))))
    return rows


def _pair_rows(lang: str, chunk: int, seq: np.ndarray, buckets: int) -> list[tuple]:
    """The chunk's sequence (bucket -1), and its pairs with their counts for the buckets of their tiles."""
    keys = pair_keys(seq)
    keys = keys[keys >= 0]
    if not len(keys):
        return []
    keys, counts = tile_counts(keys)
    bucket = (mix(tile_of(keys).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return [(lang, -1, chunk, None, pack(seq)), *((lang, b, chunk, None, pack(deltas(keys[of]), narrow(counts[of]))) for b, of in _split(bucket))]


def _tokens(documents: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        number, held, sizes = Numbers(), {}, Counter()
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(t)
                sizes[lang] += len(t) + 1
                if sizes[lang] >= chunk_bytes or sizes.total() >= 3 * chunk_bytes:
                    most = max(sizes, key=sizes.get)
                    del sizes[most]
                    yield from _batches(_word_rows(most, number(), held.pop(most), buckets))
                    pa.default_memory_pool().release_unused()
        for lang, texts in held.items():
            yield from _batches(_word_rows(lang, number(), texts, buckets))

    return written(docs.mapInArrow(run, _ROWS), "words")


def _frequent_words(rows: DataFrame, parts: int, least: int) -> DataFrame:
    """lang, bucket, word, f of the words that occur at least that often."""

    def run(batches):
        at, total = None, Counter()

        def close():
            some = [(w, f) for w, f in total.items() if f >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(some), pa.string()), pa.array([at[1]] * len(some), pa.int32()), pa.array([w.decode() for w, _ in some], pa.string()), pa.array([f for _, f in some], pa.int64())],
                names=["lang", "bucket", "word", "f"],
            )

        for batch in batches:
            for lang, bucket, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at != (lang, bucket):
                    yield close()
                    total = Counter()
                at = (lang, bucket)
                _, counts, spelled = unpack(body)
                for w, c in zip(spelled.tobytes().split(b" "), counts.tolist(), strict=True):
                    total[w] += c
        if at is not None:
            yield close()

    asked = rows.where("bucket >= 0").select("lang", "bucket", "body")
    return asked.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, "lang string, bucket int, word string, f long")


_PAIRS = "lang string, bucket int, a long, b long, f long"


def _added(rows: DataFrame, parts: int, key: list[str], least: int) -> DataFrame:
    """Runs of pairs added up for each key, without part in it as lang, bucket, a, b, f of the pairs with at least that count.

    With part in the key the sums go on as runs: lang, bucket, body.
    """
    extra = [c for c in key if c not in ("lang", "bucket")]

    def run(batches):
        at, keys, counts, held = None, [], [], 0

        def settle():
            k, n = tile_counts(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [k], [n]
            return len(k)

        def close():
            settle()
            often = counts[0] >= least
            k, n = keys[0][often], counts[0][often]
            if extra:
                return _batch([(at[0], at[1], None, None, pack(deltas(k), narrow(n)))])
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(k), pa.string()), pa.array([at[1]] * len(k), pa.int32()), pa.array(k >> 32, pa.int64()), pa.array(k & 0xFFFFFFFF, pa.int64()), pa.array(n.astype(np.int64), pa.int64())],
                names=["lang", "bucket", "a", "b", "f"],
            )

        for batch in batches:
            for *place, lang, bucket, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at != (lang, bucket, *place):
                    yield close()
                    keys, counts, held = [], [], 0
                at = (lang, bucket, *place)
                k, n = unpack(body)
                keys.append(np.cumsum(k, dtype=np.int64))
                counts.append(n.astype(np.int64))
                held += len(k)
                if held > 1 << 20:  # so no more is held than twice the distinct pairs
                    held = -settle()  # its distinct pairs come on top
        if at is not None:
            yield close()

    asked = rows.select(*extra, "lang", "bucket", "body").repartition(parts, *key).sortWithinPartitions(*key)
    return asked.mapInArrow(run, _ROWS if extra else _PAIRS)


def _frequent_pairs(rows: DataFrame, parts: int, least: int, spread: int) -> DataFrame:
    """lang, bucket, a, b, f of the pairs that occur at least that often."""
    runs = rows.where("bucket >= 0")
    if spread > 1:
        runs = _added(runs.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(spread))), parts, ["lang", "bucket", "part"], 1)
    return _added(runs, parts, ["lang", "bucket"], least)


def ranked(df: DataFrame, *order) -> DataFrame:
    """The rows with id: their place (from 0) in the order within their lang; sorted by ranges, no lang in one task."""
    spread = written(df.sort("lang", *order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    spread = spread.withColumn("range", F.shiftrightunsigned("at", 33))
    firsts = spread.groupBy("lang", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # one row for each range and lang
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.join(firsts.withColumn("before", before).drop("n"), ["lang", "range"]).withColumn("id", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before")


def _next(rows: DataFrame, frequent: DataFrame, parts: int, buckets: int, spread: int, words: bool) -> DataFrame:
    """Sequences of the frequent words' or pairs' ids, and the requests of the pairs in them, for the next round."""
    key = "word" if words else F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("key")
    name = "word" if words else "key"
    answers = frequent.select("lang", "bucket", F.struct(key, "id").alias("pair")).groupBy("lang", "bucket").agg(F.sort_array(F.collect_list("pair")).alias("known"))
    answers = answers.select("lang", "bucket", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("body"), F.col(f"known.{name}").alias("keys"), F.col("known.id").alias("ids"))
    asked = rows.where("bucket >= 0").select("lang", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(spread)).cast("int").alias("part"), "chunk", "body", F.lit(None).cast(answers.schema["keys"].dataType).alias("keys"), F.lit(None).cast("array<long>").alias("ids"))

    def reply(batches):
        known = ids = at = None
        for batch in batches:
            out = []
            place = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4)), strict=True)
            for i, (lang, bucket, part, chunk, body) in enumerate(place):
                if chunk < 0:
                    at, ids = (lang, bucket, part), np.array(batch.column(6)[i].values, np.int64)
                    known = batch.column(5)[i].values
                    known = dict(zip((w.encode() for w in known.to_pylist()), ids.tolist(), strict=True)) if words else np.array(known, np.int64)
                    continue
                if at != (lang, bucket, part):
                    continue  # nothing frequent in the bucket
                if words:
                    codes, _, spelled = unpack(body)
                    got = np.array([known.get(w, -1) for w in spelled.tobytes().split(b" ")], np.int64)
                    some = got >= 0
                    found, got = codes[some].astype(np.int64), got[some]
                else:
                    asked_, _ = unpack(body)
                    asked_ = np.cumsum(asked_, dtype=np.int64)
                    where = np.minimum(np.searchsorted(known, asked_), len(known) - 1)
                    some = known[where] == asked_
                    found, got = asked_[some], ids[where[some]]
                if len(found):
                    out.append((lang, 0, chunk, None, pack(found, narrow(got))))
            yield from _batches(out)

    both = answers.unionByName(asked).repartition(parts, "lang", "bucket", "part").sortWithinPartitions("lang", "bucket", "part", "chunk")
    replies = both.mapInArrow(reply, _ROWS).select("chunk", "lang", "body", F.lit(0).alias("kind"))
    state = rows.where("bucket < 0").select("chunk", "lang", "body", F.lit(1).alias("kind"))

    def update(batches):
        bodies: list[bytes] = []
        for batch in batches:
            for chunk, lang, body, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    bodies.append(body)
                    continue
                (seq,) = unpack(body)
                if bodies:
                    found, ids = (np.concatenate(x) for x in zip(*map(unpack, bodies), strict=True))
                    order = np.argsort(found)
                    found, ids = found[order], ids[order].astype(np.int64)
                    keys = seq.astype(np.int64) if words else pair_keys(seq)
                    where = np.minimum(np.searchsorted(found, keys), len(found) - 1)
                    new = np.where(found[where] == keys, ids[where], -1)
                    del keys, where
                    yield from _batches(_pair_rows(lang, chunk, new.astype(np.int32 if ids.max() < 2**31 else np.int64), buckets))
                bodies = []

    return written(replies.unionByName(state).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(update, _ROWS), "pairs")


def _phrases(levels: list[DataFrame]) -> list[DataFrame]:
    """Per length: lang, id, a, b, phrase, last (its last word), f, pre and suf (counts of its first and last 1, 2, ... words)."""
    out = [levels[0].select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("pre"), F.array("f").alias("suf"))]
    for level in levels[1:]:
        left = out[-1].select("lang", F.col("id").alias("a"), "phrase", F.col("pre").alias("pre"))
        right = out[-1].select("lang", F.col("id").alias("b"), "last", F.col("suf").alias("suf"))
        both = level.join(left, ["lang", "a"]).join(right, ["lang", "b"])
        out.append(written(both.select(
            "lang", "id", "a", "b", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"),
        ), "phrases"))
    return out


def best_cut(a, n, pre, suf, length: int):
    """The lowest score of the cuts, the first of equal ones: struct(score, k, l, r). Products are decimals of 38 digits."""
    big = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, length):
        left, right = F.element_at(pre, k), F.element_at(suf, length - k)
        score = F.call_function("div", F.lit(1000).cast("decimal(38,0)") * big(a) * big(n), big(left) * big(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    documents: DataFrame, least: int = FREQUENT, longest: int = LONGEST, first: int = FIRST,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, runs_per_task: int = RUNS_PER_TASK,
) -> DataFrame:
    """Per language the first phrases by score: lang, rank, phrase, a, l, r, n, score.

    A null lang is "und"; null and empty texts have no words. Rows count as often as they occur, whatever their
    doc_id. Equal scores go by a, then by the phrase's bytes. Candidates whose words lie inside a longer candidate
    that is as frequent are left out. Further columns and an empty table are harmless. a * n has to stay below 10 ** 35.
    """
    spark = documents.sparkSession
    parts, buckets = bucket_count(spark, text_bytes(documents), bucket_bytes)
    rows = _tokens(documents, buckets, chunk_bytes)
    chunks = rows.where("bucket < 0")
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    spread = -(-chunks.count() // runs_per_task) or 1
    levels = [ranked(_frequent_words(rows, parts, least), F.desc("f"), "word")]
    while len(levels) < longest:
        rows = _next(rows, levels[-1], parts, buckets, spread, words=len(levels) == 1)
        levels.append(ranked(_frequent_pairs(rows, parts, least, spread), F.desc("f"), "a", "b"))
    phrases = _phrases(levels)
    kept = []
    for length, here in enumerate(phrases[1:], 2):
        if length < longest:
            longer = phrases[length]
            inside = longer.select("lang", F.col("a").alias("id"), F.col("f").alias("most")).unionByName(longer.select("lang", F.col("b").alias("id"), F.col("f").alias("most")))
            here = here.join(inside.groupBy("lang", "id").agg(F.max("most").alias("most")), ["lang", "id"], "left").where("most is null or most < f")
        here = here.join(totals, "lang")
        kept.append(here.select("lang", "phrase", F.col("f").alias("a"), "n", best_cut(F.col("f"), F.col("n"), F.col("pre"), F.col("suf"), length).alias("cut")))
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    found = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
