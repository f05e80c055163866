"""Exact top-k by inner product with pivot-table elimination.

Every vector's distances to many pivots are computed once: the pivot table. For a query q and a
candidate x the largest |d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x), so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner product. Candidates are evaluated in the
order of their bounds until the next bound is below the k-th score found.

Candidates are never shuffled: queries travel, in batches of a bounded number of bytes, and each task
reads its candidates once a batch. Candidates lie sorted by their nearest pivot and the distance to it,
so a block spans narrow intervals of pivot distances, and a query passes over a whole block whose
intervals keep it below the k-th score. Every query starts with its k-th score in a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.llm.common import written

K = 5
SCALE = 256
PIVOTS = 32
#: Vectors of the sample from which pivots and first thresholds come.
SAMPLE = 2048
BLOCK = 2048
#: Most bytes of the queries that one broadcast holds.
BATCH_BYTES = 32 << 20
STEP = 64
#: Queries whose products with the sample are held at a time.
FLOOR_ROWS = 512
_LIMIT = 2**63


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * component) as long, for vectors without null or non-finite components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e)).alias("v")
    )


def rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as int64 rows, shorter ones padded with zeros, which leave inner products as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), flat.dtype)
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Up to count rows of x far apart from each other."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    x = x.astype(float)
    far, chosen = ((x - x.mean(axis=0)) ** 2).sum(axis=1), []
    for _ in range(min(count, len(x))):
        i = int(far.argmax())
        chosen.append(i)
        d = ((x - x[i]) ** 2).sum(axis=1)
        far = d if len(chosen) == 1 else np.minimum(far, d)
    return x[chosen]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows of x to rows of p."""
    x = x.astype(float)
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T, 0))


class Search:
    """The k best candidates of each query of a batch so far, over any blocks that come.

    ids, q and table (pivot distances) are of the queries; floors, where given, are scores that at least k
    candidates reach. seen counts the inner products that were worked out.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, table: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.q, self.table, self.k, self.seen = ids, q, table, k, 0
        self.norm = (q.astype(float) ** 2).sum(1)
        self.most = float(np.abs(q.astype(float)).max(initial=0))
        self.floor = np.full(len(q), -np.inf) if floors is None else floors.astype(float)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), ascending

    def block(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        if not len(ids):
            return
        norm = (x.astype(float) ** 2).sum(1)
        exact = self.most * float(np.abs(x.astype(float)).max(initial=0)) * max(x.shape[1], 1) < 2**52
        values = x.astype(float) if exact else np.array([[int(e) for e in row] for row in x], dtype=object).reshape(x.shape)
        across = np.ascontiguousarray(table.T)
        gap = np.zeros(len(self.q))
        if len(across):
            gap = np.maximum(across.min(1) - self.table, self.table - across.max(1)).max(1)
        for i in np.flatnonzero(self._top(self.norm, norm.max(), gap) >= self.floor).tolist():
            low = np.abs(across - self.table[i][:, None]).max(0) if len(across) else np.zeros(len(ids))
            top = self._top(self.norm[i], norm, low)
            live = np.flatnonzero((top >= self.floor[i]) & (ids != self.ids[i]))
            live = live[np.argsort(-top[live], kind="stable")]
            q = self.q[i].astype(float) if exact else np.array([int(e) for e in self.q[i]], dtype=object)
            at, step = 0, STEP
            while at < len(live) and top[live[at]] >= self.floor[i]:
                part = live[at : at + step]
                self._take(i, ids[part], values[part] @ q)
                at, step = at + len(part), step * 2

    @staticmethod
    def _top(q_norm, x_norm, low):
        """Upper bound of inner products; low is lessened by what the distances may be off by rounding."""
        low = np.maximum(low - 1e-6 * (1 + np.sqrt(q_norm) + np.sqrt(x_norm)), 0)
        return (q_norm + x_norm - low**2) / 2 + 1e-9 * (1 + q_norm + x_norm)

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.seen += len(ids)
        keep = np.flatnonzero(scores >= self.floor[i])
        if len(keep) > self.k:
            keep = keep[np.lexsort((ids[keep], -scores[keep].astype(float)))]
            # float keys may tie where integers differ: all that tie with the k-th stay
            keep = keep[scores[keep].astype(float) >= float(scores[keep[self.k - 1]])][: None if scores.dtype == object else self.k]
        if len(keep):
            self.best[i] = sorted([*self.best[i], *((-int(s), int(v)) for s, v in zip(scores[keep], ids[keep], strict=True))])[: self.k]
            if len(self.best[i]) == self.k:
                self.floor[i] = max(self.floor[i], _below(-self.best[i][-1][0]))

    def found(self) -> Iterator[tuple[int, int, int]]:
        """query_id, vec_id, score."""
        for own, best in zip(self.ids.tolist(), self.best, strict=True):
            for s, v in best:
                yield own, v, -s


def _below(score: int) -> float:
    """A float not above the score."""
    return float(score) if abs(score) < 2**53 else float(score) - abs(float(score)) * 1e-15


def _floors(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows of the sample reach, the query's own left out."""
    if len(sample) <= k:
        return np.full(len(q), -np.inf)
    scores = q.astype(float) @ sample.astype(float).T
    scores[ids[:, None] == sample_ids[None]] = -np.inf
    kth = np.partition(scores, -k, axis=1)[:, -k]
    return np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)) * max(q.shape[1], 1), -np.inf)


def top_k(vectors: DataFrame, every: int = 50, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the highest integer inner product of each query.

    Queries are the rows whose vec_id is divisible by every; candidates are all rows but those of the
    query's own vec_id. Ties go to the smaller vec_id. Vectors that are null, or hold null or non-finite
    components, and null ids take no part; vectors of other lengths count as padded with zeros; a query
    without candidates has no rows. A repeated vec_id is a candidate for each of its rows, and a query once:
    with the smallest of its vectors. Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    fine = written(scaled(vectors), "vectors")
    width, n_queries = fine.agg(F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sampled = fine.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE).toArrow()
    sample_ids, sample = sampled["vec_id"].to_numpy(), rows_of(sampled["v"], width)
    p = spread(sample, pivots)

    def tabulate(batches):
        for batch in batches:
            t = distances(rows_of(batch.column(1), width), p)
            near = t.argmin(1) if t.shape[1] else np.zeros(len(t), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, pa.array(near.astype(np.int32)), pa.array(t.min(1) if t.shape[1] else np.zeros(len(t)))],
                names=["vec_id", "v", "pivot", "near", "far"],
            )

    table = fine.mapInArrow(tabulate, "vec_id long, v array<long>, pivot array<double>, near int, far double").sortWithinPartitions("near", "far")
    table = written(table.select("vec_id", "v", "pivot"), "pivots")
    batches = -(-n_queries * 8 * (width + len(p) + 2) // BATCH_BYTES)
    queries = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "pivot")).alias("q"))
    queries = queries.select("vec_id", "q.v", "q.pivot", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(batches)).alias("b"))

    def begin(batches):  # the thresholds are worked out by the tasks, some queries at a time
        for batch in batches:
            for at in range(0, batch.num_rows, FLOOR_ROWS):
                part = batch.slice(at, FLOOR_ROWS)
                floor = _floors(part.column(0).to_numpy(), rows_of(part.column(1), width), sample_ids, sample, k)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor, pa.float64())], names=[*part.schema.names, "floor"])

    queries = written(queries.mapInArrow(begin, "vec_id long, v array<long>, pivot array<double>, b long, floor double"), "queries")
    found = None
    for b in range(batches):
        part = queries.where(F.col("b") == b).orderBy("vec_id").toArrow()  # bounded by BATCH_BYTES, but for chance
        ids, q = part["vec_id"].to_numpy(), rows_of(part["v"], width)
        sent = spark.sparkContext.broadcast((ids, q, rows_of(part["pivot"], len(p)), part["floor"].to_numpy()))

        def search(batches, sent=sent):
            own, q, of_query, floors = sent.value
            state = Search(own, q, of_query, k, floors)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    state.block(part.column(0).to_numpy(), rows_of(part.column(1), width), rows_of(part.column(2), len(p)))
            rows = list(state.found())
            for at in range(0, len(rows), 50_000):
                query, v, s = zip(*rows[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(v, pa.int64()), pa.array([max(-_LIMIT, min(_LIMIT - 1, x)) for x in s], pa.int64())], names=["query_id", "vec_id", "score"]
                )

        hits = table.mapInArrow(search, "query_id long, vec_id long, score long")
        found = hits if found is None else found.unionAll(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
