"""Matching: descriptor neighbours with a ratio test, tiling, and the built-in correlation matcher.

Learned matchers and detectors are not bundled; any function of the Matcher form takes their place.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.config import DEFAULT, Config
from regolith.functions.tables import written
from regolith.operators import blocks


class Matcher(Protocol):
    """Matches of two 8-bit patches: arrays of x, y in a, x, y in b, and confidence, one row a match."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...


#: Descriptors in a block of the neighbour search, of either side.
BLOCK = 2048


def knn_ratio(query: DataFrame, train: DataFrame, ratio: float, hamming: bool = False) -> DataFrame:
    """qid, tid, d1, d2 of queries whose nearest train descriptor is nearer than ratio times the second.

    query(qid, d) and train(tid, d) with arrays of one length; hamming compares arrays of bit words (longs).
    Both sides are dealt into blocks of bounded size; a pair of blocks is one matrix product and gives the
    two best of each query only. Null descriptors take no part; equal distances go to the smaller tid.
    """
    query, train = query.where(F.col("d").isNotNull()), train.where(F.col("d").isNotNull())
    n_query, n_train = (max(1, -(-df.count() // BLOCK)) for df in (query, train))

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own)
        return df.select(F.col(key).cast("long").alias(key), F.col("d").alias(f"{own}_d"), block, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"qid": [], "tid": [], "d": []}).astype({"qid": "int64", "tid": "int64", "d": "float64"})
        a, b = np.stack(q["i_d"].to_numpy()), np.stack(t["j_d"].to_numpy())
        tids = t["tid"].to_numpy(np.int64)
        rows, cols, d = _nearest_two(a, b, tids, hamming)
        return pd.DataFrame({"qid": q["qid"].to_numpy(np.int64)[rows], "tid": tids[cols], "d": d})

    asked, blocks = dealt(query, "qid", "i", n_query, "j", n_train), dealt(train, "tid", "j", n_train, "i", n_query)
    pairs = asked.groupBy("i", "j").cogroup(blocks.groupBy("i", "j")).applyInPandas(search, "qid long, tid long, d double")
    return _two_least(pairs.select("qid", F.struct("d", "tid").alias("x"))).where(F.col("d1") < ratio * F.col("d2"))


def _nearest_two(a: np.ndarray, b: np.ndarray, tids: np.ndarray, hamming: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, train row and distance (9 decimals) of the two nearest of each row of a, ties by tid."""
    last = min(1, len(b) - 1)
    if hamming:
        d = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            d += np.bitwise_count(a[:, k : k + 1].astype(np.int64).view(np.uint64) ^ b[:, k].astype(np.int64).view(np.uint64)[None])
        rows, cols = np.nonzero(d <= np.partition(d, last, axis=1)[:, last : last + 1])
        exact = d[rows, cols]
    else:
        a, b = a.astype(float), b.astype(float)
        a2, b2 = (a**2).sum(1), (b**2).sum(1)
        near = a2[:, None] + b2[None] - 2 * a @ b.T
        # the product rounds: whatever may be among the two nearest is measured by its differences
        reach = np.partition(near, last, axis=1)[:, last] + 1e-9 * (1 + a2 + b2.max())
        rows, cols = np.nonzero(near <= reach[:, None])
        exact = np.round(np.sqrt(((a[rows] - b[cols]) ** 2).sum(1)), 9)
    order = np.lexsort((tids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    first = np.searchsorted(rows, np.arange(len(a)))
    keep = np.arange(len(rows)) - first[rows] < 2
    return rows[keep], cols[keep], exact[keep]


def _two_least(pairs: DataFrame) -> DataFrame:
    """The two least (d, tid) of each query; Spark keeps two of a query in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("x.d", "x.tid"))
    top = pairs.withColumn("k", rank).where("k <= 2")
    one = F.max(F.when(F.col("k") == 1, F.col("x.d"))).alias("d1")
    return top.groupBy("qid").agg(F.max(F.when(F.col("k") == 1, F.col("x.tid"))).alias("tid"), one, F.max(F.when(F.col("k") == 2, F.col("x.d"))).alias("d2")).where(F.col("d2").isNotNull())


def tile_plan(sizes: DataFrame, cfg: Config = DEFAULT, multiple: int = 8, least: int = 32) -> DataFrame:
    """Tiles of each image(image_id, height, width) with their padded search windows, sides cut to multiples of 8.

    The number of tiles a side follows the shorter side; tiles or windows under 32 px are left out.
    """
    n = F.greatest(F.lit(1), F.least(F.lit(cfg.tiles), F.floor(F.least("height", "width") / cfg.min_tile_px))).cast("int")
    t = sizes.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1)))
    t = t.withColumn("ty", F.floor(F.col("k") / F.col("n"))).withColumn("tx", F.col("k") % F.col("n"))
    cut = lambda e: (F.floor(e / multiple) * multiple).cast("int")
    edge = lambda i, side: F.floor(i * F.col(side) / F.col("n"))
    t = t.withColumn("y0", edge(F.col("ty"), "height").cast("int")).withColumn("x0", edge(F.col("tx"), "width").cast("int"))
    t = t.withColumn("h", cut(edge(F.col("ty") + 1, "height") - F.col("y0"))).withColumn("w", cut(edge(F.col("tx") + 1, "width") - F.col("x0")))
    t = t.withColumn("ry0", F.greatest(F.lit(0), F.col("y0") - cfg.tile_pad)).withColumn("rx0", F.greatest(F.lit(0), F.col("x0") - cfg.tile_pad))
    t = t.withColumn("rh", cut(F.least(F.col("height"), F.col("y0") + F.col("h") + cfg.tile_pad) - F.col("ry0"))).withColumn("rw", cut(F.least(F.col("width"), F.col("x0") + F.col("w") + cfg.tile_pad) - F.col("rx0")))
    ok = (F.col("h") >= least) & (F.col("w") >= least) & (F.col("rh") >= least) & (F.col("rw") >= least)
    return t.where(ok).select("image_id", F.col("k").alias("tile_id"), "y0", "x0", "h", "w", "ry0", "rx0", "rh", "rw")


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """dx, dy, response by which b's content is moved against a's; sub-pixel by the centroid around the peak."""
    f = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    r = np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    h, w = r.shape
    y, x = np.unravel_index(int(r.argmax()), r.shape)
    ys, xs = (np.arange(-2, 3) + y) % h, (np.arange(-2, 3) + x) % w
    near = np.maximum(r[np.ix_(ys, xs)], 0)
    total = max(near.sum(), 1e-12)
    dy, dx = y + (near.sum(1) * np.arange(-2, 3)).sum() / total, x + (near.sum(0) * np.arange(-2, 3)).sum() / total
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), float(near.sum() / max(np.abs(r).sum(), 1e-12))


def correlation_matcher(a: np.ndarray, b: np.ndarray, stride: int = 8, half: int = 4, reach: int = 20, least: float = 0.5) -> np.ndarray:
    """Default matcher: centres of stride x stride cells of a, placed in b by normalised cross-correlation within reach.

    The patches of a row of centres are compared at once with the same band of b.
    """
    k, b, a = 2 * half, b.astype(float), a.astype(float)
    xs = np.arange(half, a.shape[1] - half + 1, stride)
    found = []
    for y in range(half, a.shape[0] - half + 1, stride):
        y0 = max(0, y - half - reach)
        band = b[y0 : y + half + reach]
        if band.shape[0] < k or band.shape[1] < k or not len(xs):
            continue
        patches = np.stack([a[y - half : y + half, x - half : x + half] for x in xs]).reshape(len(xs), -1)
        sd_a = patches.std(1)
        views = np.lib.stride_tricks.sliding_window_view(band, (k, k))
        rows, cols = views.shape[:2]
        flat = views.reshape(rows * cols, k * k)
        sd_b = flat.std(1)
        score = (patches - patches.mean(1, keepdims=True)) @ flat.T / (k * k * np.maximum(sd_a, 1e-9)[:, None] * np.maximum(sd_b, 1e-6)[None])
        score = score.reshape(len(xs), rows, cols)
        away = np.abs(np.arange(cols)[None] + half - xs[:, None]) > reach
        score[np.broadcast_to(away[:, None, :], score.shape)] = -np.inf
        best = score.reshape(len(xs), -1).argmax(1)
        value = score.reshape(len(xs), -1)[np.arange(len(xs)), best]
        i, j = np.divmod(best, cols)
        fine = (sd_a >= 1e-3) & (value >= least) & (sd_b[best] >= 1e-3)
        found.append(np.stack([xs, np.full(len(xs), y), j + half, y0 + i + half, value], 1)[fine])
    return np.concatenate(found) if found else np.zeros((0, 5))


def match_tiles(source: DataFrame, reference: DataFrame, matcher: Matcher = correlation_matcher, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, match_id, tile_id, xa, ya, xb, yb, conf of tiles of source(image_id, r, c, u) in reference of the same ids and size.

    A tile with its search window is a group of two boxes; image_id becomes pair_id. Cells without data count as 0.
    """
    from regolith.operators.raster import extent

    plan = written(tile_plan(extent(source), cfg), "tiles")
    group = F.concat_ws("|", F.col("tile_id").cast("string"), "image_id").alias("group")
    none = F.lit(None).cast("binary").alias("note")
    part = lambda side, r, c, h, w: plan.select(
        group, F.lit(side).alias("side"), F.concat(F.lit("ab"[side]), F.col("image_id").cast("string")).alias("image_id"), F.col(r).alias("r0"), F.col(c).alias("c0"), F.col(h).alias("h"), F.col(w).alias("w"), none
    )
    named = lambda df, side: df.select(F.concat(F.lit(side), F.col("image_id").cast("string")).alias("image_id"), "r", "c", "u")
    tiled = blocks.to_blocks(named(source, "a").unionByName(named(reference, "b")), "u")
    parts = blocks.pieces(tiled, part(0, "y0", "x0", "h", "w").unionByName(part(1, "ry0", "rx0", "rh", "rw")))

    def run(groups):
        for name, sides in groups:
            if len(sides) < 2:
                continue
            tile, pair = name.split("|", 1)
            (y0, x0, a, _), (ry0, rx0, b, _) = sides[0], sides[1]
            a, b = np.nan_to_num(a), np.nan_to_num(b)
            # the search window starts elsewhere: a is placed in a frame of b's origin for the reach
            frame, dy, dx = np.zeros_like(b), y0 - ry0, x0 - rx0
            fh, fw = min(a.shape[0], frame.shape[0] - dy), min(a.shape[1], frame.shape[1] - dx)
            frame[dy : dy + fh, dx : dx + fw] = a[:fh, :fw]
            m = matcher(frame, b)
            m = m[(m[:, 0] >= dx) & (m[:, 1] >= dy) & (m[:, 0] < dx + fw) & (m[:, 1] < dy + fh)]
            n, t = len(m), int(tile)
            columns = (m[:, 0] + rx0, m[:, 1] + ry0, m[:, 2] + rx0, m[:, 3] + ry0, m[:, 4])
            yield pa.RecordBatch.from_arrays(
                [pa.array([pair] * n, pa.string()), pa.array(np.arange(n) + t * 1_000_000, pa.int64()), pa.array(np.full(n, t), pa.int64()), *(pa.array(c.astype(float)) for c in columns)],
                names=["pair_id", "match_id", "tile_id", "xa", "ya", "xb", "yb", "conf"],
            )

    return blocks.over_boxes(parts, run, "pair_id string, match_id long, tile_id long, xa double, ya double, xb double, yb double, conf double").where(F.col("conf") >= cfg.confidence)


def phase_shifts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dx, dy of each pair of patches in two stacks, as phase_shift() gives them."""
    f = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    r = np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    n, h, w = r.shape
    y, x = np.divmod(r.reshape(n, -1).argmax(1), w)
    near = np.arange(-2, 3)
    ys, xs = (near + y[:, None]) % h, (near + x[:, None]) % w
    peak = np.maximum(r[np.arange(n)[:, None, None], ys[:, :, None], xs[:, None, :]], 0)
    total = np.maximum(peak.sum((1, 2)), 1e-12)
    dy, dx = y + (peak.sum(2) @ near) / total, x + (peak.sum(1) @ near) / total
    return np.stack([np.where(dx > w / 2, dx - w, dx), np.where(dy > h / 2, dy - h, dy)], 1)


def refine(matches: DataFrame, source: DataFrame, reference: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Sub-pixel matches: the phase shift of Hanning-weighted patches is added to the reference point.

    The patches of a match are two boxes of block rasters; many matches are worked out at once. Matches near a border,
    on flat patches or cells without data, or with a shift over the limit are left out.
    """
    half = cfg.refine_patch
    hann = np.outer(np.hanning(2 * half), np.hanning(2 * half))
    named = lambda df, side: df.select(F.concat(F.lit(side), F.col("image_id").cast("string")).alias("image_id"), "r", "c", "u")
    tiled = blocks.to_blocks(named(source, "a").unionByName(named(reference, "b")), "u")
    group = F.concat_ws("|", F.col("match_id").cast("string"), F.col("pair_id").cast("string")).alias("group")

    def box(side: int, x: str, y: str) -> DataFrame:
        first = lambda c: (F.rint(c) - half).cast("int")
        return matches.select(
            group, F.lit(side).alias("side"), F.concat(F.lit("ab"[side]), F.col("pair_id").cast("string")).alias("image_id"),
            first(y).alias("r0"), first(x).alias("c0"), F.lit(2 * half).alias("h"), F.lit(2 * half).alias("w"), F.lit(None).cast("binary").alias("note"),
        )

    def run(groups):
        names, stacks = [], []
        for name, sides in groups:
            if len(sides) == 2:
                pair = np.stack([sides[0][2], sides[1][2]])
                sd = pair.std((1, 2))  # NaN past a border
                if (sd >= 1e-3).all():
                    names.append(name)
                    stacks.append((pair - pair.mean((1, 2), keepdims=True)) / sd[:, None, None] * hann)
        if not names:
            return
        stack = np.stack(stacks)
        shift = phase_shifts(stack[:, 0], stack[:, 1])
        keep = np.hypot(*shift.T) <= cfg.refine_max_shift
        keys = [n.split("|", 1) for n, k in zip(names, keep.tolist(), strict=True) if k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[1] for k in keys], pa.string()), pa.array([int(k[0]) for k in keys], pa.int64()), pa.array(shift[keep, 0]), pa.array(shift[keep, 1])], names=["pair_id", "match_id", "sx", "sy"]
        )

    parts = blocks.pieces(tiled, box(0, "xa", "ya").unionByName(box(1, "xb", "yb")))
    shifts = blocks.over_boxes(parts, run, "pair_id string, match_id long, sx double, sy double").withColumn("pair_id", F.col("pair_id").cast(matches.schema["pair_id"].dataType))
    return matches.join(shifts, ["pair_id", "match_id"]).withColumn("xb", F.rint("xb") + F.col("xa") - F.rint("xa") + F.col("sx")).withColumn("yb", F.rint("yb") + F.col("ya") - F.rint("ya") + F.col("sy"))
