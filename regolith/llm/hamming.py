"""SimHash fingerprints and their links within a Hamming radius, by shards of BK-trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import first_rows, sized, written
from regolith.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
#: Most nodes of one shard tree, and most fingerprints of a shard that one task cuts by a second block.
TREE_NODES = 2048
SHARD_POINTS = 1 << 17


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half the XXH64 of the shingles."""
    tokens = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of hashes made before: a bit is set if it is set in over half of them; of none, zero."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = np.ascontiguousarray(hashes[at : at + (1 << 15)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row_key and the signed 64-bit fingerprint of every row; a null text is an empty one."""

    def run(batches):
        for batch in batches:
            f = [fingerprint(t or b"", words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(f, dtype=np.uint64).view(np.int64))], names=["doc_id", "row_key", "fp"]
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.cast("binary").alias("data")
    ).mapInArrow(run, "doc_id long, row_key long, fp long")


class Forest:
    """BK-trees over the distinct uint64 points of consecutive groups, built and searched level by level.

    The first point of a group is its root; the others hang below the child of their distance to it, and so
    on: at every level the first point of each (parent, distance) becomes the node. Edges lie sorted by
    parent and distance, so the children that a query follows are a range of them.
    """

    def __init__(self, points: np.ndarray, group: np.ndarray):
        n = len(points)
        self.points, self.visits = points, 0
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.arange(n)
        key = group.astype(np.int64)
        self.roots = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else rest
        while len(rest):
            start = np.concatenate(([True], key[1:] != key[:-1]))
            node = rest[np.flatnonzero(start)][np.cumsum(start) - 1]
            below = ~start
            rest, node = rest[below], node[below]
            parent[rest], edge[rest] = node, np.bitwise_count(points[rest] ^ points[node])
            order = np.argsort(parent[rest] * 128 + edge[rest], kind="stable")
            rest = rest[order]
            key = parent[rest] * 128 + edge[rest]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 128 + edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def search(self, queries: np.ndarray, node: np.ndarray, radius: int):
        """Yields (query index, point index) arrays of pairs within the radius; queries start at the given nodes."""
        at = np.arange(len(queries))
        while len(at):
            self.visits += len(at)
            d = np.bitwise_count(queries[at] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield at[hit], node[hit]
            low = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.key, node * 128 + np.minimum(d + radius, 64), "right") - low
            first = np.cumsum(count) - count
            node = self.child[np.arange(count.sum()) - np.repeat(first - low, count)]
            at = np.repeat(at, count)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) of the components once each a is joined to its b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, again := label[label]):
            label = again
    return label


def shard_links(group: np.ndarray, mine: np.ndarray, asks: np.ndarray, points: np.ndarray, radius: int, most: int = 1 << 22):
    """Member and root of a spanning forest of the links in each of consecutive groups.

    Points marked mine make up the group's tree, those marked asks search it; most bounds the pairs of query
    and node that are held at once.
    """
    order = np.concatenate((np.flatnonzero(mine), np.flatnonzero(~mine)))
    nodes = int(mine.sum())
    tree = Forest(points[order[:nodes]], group[order[:nodes]])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    label = np.arange(len(order))
    roots, of_group = tree.roots, group[order[:nodes]][tree.roots]
    queries = np.flatnonzero(asks)
    seat = np.searchsorted(of_group, group[queries])
    found = (seat < len(of_group)) & (of_group[np.minimum(seat, len(of_group) - 1)] == group[queries]) if len(of_group) else np.zeros(len(queries), bool)
    queries, seat = queries[found], seat[found]
    size = np.diff(np.append(roots, nodes))[seat]
    step = np.cumsum(size) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(queries)]))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for at, node in tree.search(points[queries[i:j]], roots[seat[i:j]], radius):
            label = unite(label, place[queries[i:j][at]], node)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return points[order[moved]], points[order[label[moved]]]


def _blocks(value, width: int, count: int):
    """The lowest width bits of value in count blocks: (value, position, width) of each."""
    at, out = 0, []
    for i in range(count):
        w = (width - at) // (count - i)
        out.append((F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << w) - 1).cast("long")), at, w))
        at += w
    return out


def shard_keys(radius: int, inner: bool = False):
    """Two fingerprints within the radius agree on one of radius + 1 blocks of bits: a key (shard, sub) for each.

    The inner keys cut the other bits into radius + 1 blocks again, as two fingerprints of a shard agree on
    one of those as well.
    """
    keys = []
    for i, (block, at, w) in enumerate(_blocks(F.col("fp"), 64, radius + 1)):
        shard = F.lit(i).cast("long") * F.lit(1 << 48) + block
        if not inner:
            keys.append(F.struct(shard.alias("shard"), F.lit(-1).cast("long").alias("sub")))
            continue
        low = F.col("fp").bitwiseAND(F.lit((1 << at) - 1).cast("long"))
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", at + w), at)) if at + w < 64 else low
        keys += [F.struct(shard.alias("shard"), (F.lit(j).cast("long") * F.lit(1 << 48) + b).alias("sub")) for j, (b, _, _) in enumerate(_blocks(rest, 64 - w, radius + 1))]
    return F.array(*keys)


def _rest_blocks(points: np.ndarray, at: int, width: int, count: int):
    """The bits outside of at..at + width in count blocks, as shard_keys cuts them."""
    rest = points & np.uint64((1 << at) - 1)
    if at + width < 64:
        rest = rest | (points >> np.uint64(at + width)) << np.uint64(at)
    low = 0
    for i in range(count):
        w = (64 - width - low) // (count - i)
        yield rest >> np.uint64(low) & np.uint64((1 << w) - 1)
        low += w


def cut_links(points: np.ndarray, block: int, radius: int):
    """Member and root of a spanning forest of the links of a shard, whose points agree on the block: by trees of those that agree on a second one."""
    ends = [0]
    for i in range(radius + 1):
        ends.append(ends[-1] + (64 - ends[-1]) // (radius + 1 - i))
    at, width = ends[block], ends[block + 1] - ends[block]
    points = np.sort(points)
    label = np.arange(len(points))
    for sub in _rest_blocks(points, at, width, radius + 1):
        order = np.argsort(sub, kind="stable")
        whole = np.ones(len(points), bool)
        group = np.cumsum(np.concatenate(([True], sub[order][1:] != sub[order][:-1]))) - 1
        a, b = shard_links(group, whole, whole, points[order], radius)
        label = unite(label, np.searchsorted(points, a), np.searchsorted(points, b))
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _shards(shard: np.ndarray, points: np.ndarray):
    """Number of the block and points of each of consecutive shards."""
    cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)])) if len(shard) else np.zeros(1, int)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield shard[i] >> 48, points[i:j]


def hamming_links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius: a spanning forest for each shard.

    A shard holds the fingerprints that agree on one of radius + 1 blocks of bits; its BK-tree decides which
    of them are within the radius. A shard of more than tree_nodes is cut by a second block: by the task that has it,
    which needs no copies on disk, up to SHARD_POINTS; a larger one by the shuffle, and what is still larger than
    a tree is dealt over several trees that its fingerprints visit one after the other, so a hot shard is never one
    group. Trees reach their queries by the shuffle: together they hold the fingerprints of all documents, for which
    there is no bounded broadcast.
    """
    def crowded(keys, most):
        return written(keys.groupBy("shard", "sub").count().where(F.col("count") > most), "crowded")

    def spread(keys):
        return keys.select("fp", F.explode("keys").alias("k")).select("fp", "k.shard", "k.sub")

    keys = spread(distinct.select("fp", shard_keys(radius).alias("keys")))  # worked out again where needed, not written
    large = crowded(keys, max(tree_nodes, SHARD_POINTS))
    n_large = large.count()
    if n_large:
        names = sized(large.select("shard"), n_large)
        finer = spread(distinct.select("fp", shard_keys(radius, inner=True).alias("keys"))).join(names, "shard", "left_semi")
        finer = written(finer, "shards")
        keys = keys.join(names, "shard", "left_anti").unionByName(finer)
        large = crowded(finer, tree_nodes)
        n_large = large.count()
    parts = F.lit(None).cast("int")
    if n_large:
        keys = keys.join(sized(large.select("shard", "sub", F.ceil(F.col("count") / tree_nodes).cast("int").alias("parts")), n_large), ["shard", "sub"], "left")
        parts = F.col("parts")
    own = F.when(parts.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp", F.lit(5)), parts).cast("int"))
    dealt = keys.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).select(
        "shard", "sub", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp"
    )

    def run(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]) < 1 << 17:
                continue
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:4]], axis=0)) + 1
            if len(change):
                yield from links_of([c[: change[-1]] for c in held])
                held = [c[change[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield from links_of(held)

    def links_of(cols):
        shard, sub, a, b, own, fp = cols
        start = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in (shard, sub, a, b)], axis=0)))
        group = np.cumsum(start) - 1
        size = np.bincount(group)[group]
        cut = (size > tree_nodes) & (sub == -1)
        found = [cut_links(points, int(block), radius) for block, points in _shards(shard[cut], fp[cut].view(np.uint64))]
        some = (size > 1) & ~cut
        if some.any():
            group, a, b, own, points = (x[some] for x in (group, a, b, own, fp.view(np.uint64)))
            found.append(shard_links(group, own == a, own == b, points, radius))
        for x, y in found:
            for at in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000].view(np.int64)) for v in (x, y)], names=["a", "b"])

    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = dealt.repartition(n, "shard", "sub", "a", "b").sortWithinPartitions("shard", "sub", "a", "b", "fp")
    return shards.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, row_key, fp (signed) and component_id, the smallest doc_id reachable over links.

    Rows with equal fingerprints are one class; only distinct fingerprints are searched. Texts that are
    null or without words have fingerprint zero and link like any other. A null doc_id is never a
    component_id unless every row of the component has none; repeated rows are kept.
    """
    fps = written(fingerprints(documents, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = written(hamming_links(classes.select("fp"), radius), "links")
    member = connected_components(edges)  # node, root
    rooted = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    of_class = written(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return fps.join(of_class, "fp", "left").select("doc_id", "row_key", "fp", "component_id")


def keep_one(documents: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents with one row kept of each near-duplicate component: that of the smallest doc_id.

    Of rows that repeat this doc_id the one with the smallest text hash stays; of full repeats, one.
    """
    near = written(near_duplicates(documents, words, radius), "near")
    best = near.groupBy("component_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row_key")).alias("first"))
    return first_rows(documents, written(best.select("first.id", "first.row_key").distinct(), "firsts"))
