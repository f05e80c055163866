"""Scale-space features of rasters: blobs over a pyramid of blurred rasters, described by histograms of gradients.

The pyramid is a block raster, an image_id for each octave ("octave:image"). Blobs, their ranking and their
descriptors are relations between block rasters and keypoints: a box of cells around a block is read once for all
keypoints in it. Cells without data take no part in a blur, and no keypoint lies within BORDER cells of one.

Unlike common libraries this starts at the image's own size (not doubled) and measures angles from +x towards +y.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.functions.tables import written
from regolith.operators import blocks, matching

#: Blur of an octave's first level, blur that a raw image is taken to have, and levels in which blobs are sought.
SIGMA, SEEN, SCALES = 1.6, 0.5, 3
#: Least difference (of the values' span, over all levels), and most ratio of the principal curvatures.
CONTRAST, EDGE = 0.04, 10.0
BORDER, MOVES = 5, 5
#: Bins of the orientation histogram, share of its peak that makes another feature, and the descriptor's cells and bins.
TURNS, PEAK, CELLS, BINS = 36, 0.8, 4, 8

_KEY = "image_id string, octave int, level int, ri int, ci int, y double, x double, scale double, response double"


def deviations(octave: int) -> list[float]:
    """What an octave's raster is still to be blurred by for each of its levels."""
    known = SIGMA if octave else SEEN
    return [math.sqrt((SIGMA * 2 ** (s / SCALES)) ** 2 - known**2) for s in range(SCALES + 3)]


def taps(sigma: float) -> np.ndarray:
    """A Gaussian over four deviations to each side; not normalised, as blurs divide by the weights of cells with data."""
    half = math.ceil(4 * sigma)
    return np.exp(-np.arange(-half, half + 1) ** 2.0 / (2 * sigma * sigma)) if half else np.ones(1)


def reach(octave: int, level: int) -> int:
    return len(taps(deviations(octave)[level])) // 2


def _along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    half, n = len(weights) // 2, x.shape[axis]
    wide = np.pad(x, [(half, half) if a == axis else (0, 0) for a in (0, 1)])
    out = np.zeros_like(x)
    for k, w in enumerate(weights):
        out += w * (wide[k : k + n] if axis == 0 else wide[:, k : k + n])
    return out


def blurred(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Weighted means of the cells with data; NaN stays where there are none."""
    seen, weights = ~np.isnan(grid), taps(sigma)
    top, low = np.where(seen, grid, 0.0), seen.astype(float)
    for axis in (0, 1):
        top, low = _along(top, weights, axis), _along(low, weights, axis)
    out = np.full(grid.shape, np.nan)
    np.divide(top, low, out=out, where=seen)
    return out


def _boxes(places: DataFrame, step: int, halo: int, note=None) -> DataFrame:
    """A box around each place(image_id, ty, tx), of blocks of step cells."""
    return places.select(
        F.concat_ws("|", F.col("ty").cast("string"), F.col("tx").cast("string"), "image_id").alias("group"), F.lit(0).alias("side"), "image_id",
        (F.col("ty") * step - halo).cast("int").alias("r0"), (F.col("tx") * step - halo).cast("int").alias("c0"), F.lit(step + 2 * halo).alias("h"), F.lit(step + 2 * halo).alias("w"),
        (F.lit(None) if note is None else note).cast("binary").alias("note"),
    )


def _octave_of(image: str) -> tuple[int, str]:
    octave, name = image.split(":", 1)
    return int(octave), name


def pyramid(tiled: DataFrame, octaves: int, side: int = blocks.SIDE) -> DataFrame:
    """Octaves of a block raster: each is the one before, blurred to twice its first level, at its even cells."""
    level = written(tiled.withColumn("image_id", F.concat(F.lit("0:"), "image_id")), "octave")
    out = level
    for octave in range(octaves - 1):  # each an eighth of the cells' reads of the one before
        halo, sigma = reach(octave, SCALES), deviations(octave)[SCALES]
        places = level.select("image_id", F.floor(F.col("ty") / 2).alias("ty"), F.floor(F.col("tx") / 2).alias("tx")).distinct()

        def halve(groups, halo=halo, sigma=sigma, octave=octave):
            rows = []
            for group, sides in groups:
                ty, tx, image = group.split("|", 2)
                half = blurred(sides[0][2], sigma)[halo : halo + 2 * side : 2, halo : halo + 2 * side : 2]
                r, c = np.nonzero(~np.isnan(half))
                if len(r):
                    h, w = int(r.max()) + 1, int(c.max()) + 1
                    rows.append((f"{octave + 1}:{_octave_of(image)[1]}", int(ty), int(tx), int(ty) * side, int(tx) * side, h, w, half[:h, :w].tobytes()))
            if rows:
                yield blocks._rows(rows)

        level = written(blocks.over_boxes(blocks.pieces(level, _boxes(places, 2 * side, halo), side), halve, blocks.SCHEMA), "octave")
        out = out.unionByName(level)
    return out


def _differences(cells: np.ndarray, octave: int) -> np.ndarray:
    levels = [blurred(cells, s) for s in deviations(octave)]
    return np.stack([b - a for a, b in zip(levels, levels[1:], strict=False)])


def _peaks(d: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, row and column of what is over least and all 26 neighbours, or under -least and all of them."""
    mid = d[1:-1, 1:-1, 1:-1]
    more, less = mid > least, mid < -least
    for s in range(3):
        for r in range(3):
            for c in range(3):
                if (s, r, c) != (1, 1, 1):
                    other = d[s : d.shape[0] - 2 + s, r : d.shape[1] - 2 + r, c : d.shape[2] - 2 + c]
                    more &= mid > other  # false beside cells without data
                    less &= mid < other
    s, r, c = np.nonzero(more | less)
    return s + 1, r + 1, c + 1


def _inner(cells: np.ndarray) -> np.ndarray:
    """Cells with data that have no cell without data within BORDER."""
    n = 2 * BORDER + 1
    seen = (~np.isnan(cells)).astype(float)
    return _along(_along(seen, np.ones(n), 0), np.ones(n), 1) > n * n - 0.5


def _trimmed(cells: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Rows and columns before the first cell with data, and the part of the box that has data.

    Cells without data take no part in blurs and no blob is beside one, so kernels need not go over them: a box around
    a small image, or a late octave, is mostly such cells.
    """
    seen = ~np.isnan(cells)
    r, c = np.flatnonzero(seen.any(1)), np.flatnonzero(seen.any(0))
    if not len(r):
        return 0, 0, cells[:0, :0]
    return int(r[0]), int(c[0]), cells[r[0] : r[-1] + 1, c[0] : c[-1] + 1]


def _settle(d: np.ndarray, s: np.ndarray, r: np.ndarray, c: np.ndarray, least: float):
    """The peaks of fitted paraboloids: rows kept of the given ones, their cells, offsets and values.

    A peak whose offset is over half a cell moves to that cell, MOVES times at most; peaks that do not settle, leave
    the levels, are too faint or lie on an edge are dropped.
    """
    at, alive = np.stack([s, r, c]), np.arange(len(s))
    done: list[tuple] = []
    unit = np.eye(3, dtype=int)
    for move in range(MOVES):
        value = lambda *o: d[tuple(at + sum(o, np.zeros(3, int))[:, None])]  # noqa: B023, E731
        g = np.stack([(value(e) - value(-e)) / 2 for e in unit], 1)
        h = np.empty((len(alive), 3, 3))
        for i in range(3):
            h[:, i, i] = value(unit[i]) + value(-unit[i]) - 2 * value()
            for j in range(i):
                h[:, i, j] = h[:, j, i] = (value(unit[i], unit[j]) - value(unit[i], -unit[j]) - value(-unit[i], unit[j]) + value(-unit[i], -unit[j])) / 4
        sound = np.isfinite(h).all((1, 2)) & (np.abs(np.linalg.det(np.nan_to_num(h))) > 1e-300)
        off = np.zeros((len(alive), 3))
        off[sound] = -np.linalg.solve(h[sound], g[sound][:, :, None])[:, :, 0]
        still = sound & (np.abs(off) < 0.5).all(1)
        det = h[:, 1, 1] * h[:, 2, 2] - h[:, 1, 2] ** 2
        top = value() + (g * off).sum(1) / 2
        round_ = (det > 0) & ((h[:, 1, 1] + h[:, 2, 2]) ** 2 * EDGE < (EDGE + 1) ** 2 * det)
        good = still & round_ & (np.abs(top) >= least)
        done.append((alive[good], at[:, good], off[good], top[good]))
        step = np.rint(np.clip(off, -1e6, 1e6)).astype(int).T
        on = sound & ~still & (np.abs(step) <= 2).all(0)
        to = at + step
        on &= (to[0] >= 1) & (to[0] <= SCALES)
        for axis in (1, 2):
            on &= (to[axis] >= 1) & (to[axis] < d.shape[axis] - 1)
        at, alive = to[:, on], alive[on]
        if not len(alive) or move == MOVES - 1:
            break
    return tuple(np.concatenate([x[k] for x in done], 1 if k == 1 else 0) for k in range(4))


def keypoints(octaves: DataFrame, span: float = 1.0, contrast: float = CONTRAST, settled: bool = True, side: int = blocks.SIDE) -> DataFrame:
    """Blobs of a pyramid: image_id, octave, level, their cell ri, ci, and place y, x, scale and response in the octave.

    span is the width of the values' range. Unsettled blobs are the bare extrema whose difference is over half of what
    settled ones need. A blob that two extrema settle on comes once; a plateau has none.
    """
    least = contrast * span / SCALES
    halo = max(reach(o, SCALES + 2) for o in (0, 1)) + max(BORDER, 2 * MOVES + 2)

    def run(groups):
        for group, sides in groups:
            octave, name = _octave_of(group.split("|", 2)[2])
            r0, c0, cells, _ = sides[0]
            top, left, cells = _trimmed(cells)
            if min(cells.shape) <= 2 * BORDER:
                continue
            r0, c0, inner = r0 + top, c0 + left, _inner(cells)
            if not inner.any():
                continue
            d = _differences(cells, octave)
            s, r, c = _peaks(d, least / 2)
            own = (r + top >= halo) & (r + top < halo + side) & (c + left >= halo) & (c + left < halo + side)
            own &= inner[r, c]
            s, r, c = s[own], r[own], c[own]
            off, top = np.zeros((len(s), 3)), d[s, r, c]
            if settled and len(s):
                _, (s, r, c), off, top = _settle(d, s, r, c, least)
                own = inner[r, c]
                s, r, c, off, top = s[own], r[own], c[own], off[own], top[own]
            n = len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array([octave] * n, pa.int32()), *(pa.array(x.astype(np.int32)) for x in (s, r + r0, c + c0)),
                 pa.array(r + r0 + off[:, 1]), pa.array(c + c0 + off[:, 2]), pa.array(SIGMA * 2 ** ((s + off[:, 0]) / SCALES)), pa.array(top)],
                names=[x.split()[0] for x in _KEY.split(", ")],
            )

    found = blocks.over_boxes(blocks.pieces(octaves, _boxes(octaves.select("image_id", "ty", "tx").distinct(), side, halo), side), run, _KEY)
    return found.dropDuplicates(["image_id", "octave", "level", "ri", "ci"]) if settled else found


def strongest(keys: DataFrame, most: int) -> DataFrame:
    """The most keypoints of each image that differ most; ties by octave, level and cell. Spark keeps as many in each task before the shuffle."""
    order = Window.partitionBy("image_id").orderBy(F.abs("response").desc(), "octave", "level", "ri", "ci")
    return keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def _orientations(gx: np.ndarray, gy: np.ndarray, y: float, x: float, scale: float) -> list[float]:
    radius, wide = round(4.5 * scale), 1.5 * scale
    i, j = round(y), round(x)
    part = np.s_[max(i - radius, 0) : i + radius + 1, max(j - radius, 0) : j + radius + 1]
    a, b = gx[part], gy[part]
    rr, cc = np.mgrid[part]
    seen = ~np.isnan(a + b)
    a, b, near = a[seen], b[seen], ((rr - i) ** 2 + (cc - j) ** 2)[seen]
    bins = np.rint(np.arctan2(b, a) * TURNS / (2 * math.pi)).astype(int) % TURNS
    h = np.bincount(bins, np.hypot(a, b) * np.exp(-near / (2 * wide * wide)), TURNS)
    h = (np.roll(h, 2) + np.roll(h, -2) + 4 * (np.roll(h, 1) + np.roll(h, -1)) + 6 * h) / 16
    left, right = np.roll(h, 1), np.roll(h, -1)
    out = []
    for k in np.flatnonzero((h > left) & (h > right) & (h >= PEAK * h.max())):
        out.append((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * h[k] + right[k])) * 2 * math.pi / TURNS % (2 * math.pi))
    return out


def _reach_of_descriptor(scale: float) -> int:
    return round(3 * scale * math.sqrt(2) * (CELLS + 1) / 2)


def _descriptor(gx: np.ndarray, gy: np.ndarray, y: float, x: float, scale: float, angle: float) -> np.ndarray | None:
    """CELLS x CELLS histograms of BINS directions about (y, x), turned by angle; each sample goes to the eight bins around it."""
    radius, i, j = _reach_of_descriptor(scale), round(y), round(x)
    part = np.s_[max(i - radius, 0) : i + radius + 1, max(j - radius, 0) : j + radius + 1]
    rr, cc = np.mgrid[part]
    dy, dx = (rr - y) / (3 * scale), (cc - x) / (3 * scale)
    u, v = math.cos(angle) * dx + math.sin(angle) * dy, math.cos(angle) * dy - math.sin(angle) * dx
    a, b, row, col = gx[part], gy[part], v + CELLS / 2 - 0.5, u + CELLS / 2 - 0.5
    ok = (row > -1) & (row < CELLS) & (col > -1) & (col < CELLS) & ~np.isnan(a + b)
    a, b, row, col = a[ok], b[ok], row[ok], col[ok]
    weight = np.hypot(a, b) * np.exp(-(u[ok] ** 2 + v[ok] ** 2) / (0.5 * CELLS * CELLS))
    turn = (np.arctan2(b, a) - angle) * BINS / (2 * math.pi)
    low = np.stack([np.floor(row), np.floor(col), np.floor(turn)]).astype(int)
    past = np.stack([row, col, turn]) - low
    h = np.zeros((CELLS + 2) * (CELLS + 2) * BINS)
    for p in np.ndindex(2, 2, 2):
        share = np.prod([past[k] if p[k] else 1 - past[k] for k in range(3)], 0)
        at = ((low[0] + p[0] + 1) * (CELLS + 2) + low[1] + p[1] + 1) * BINS + (low[2] + p[2]) % BINS
        h += np.bincount(at, weight * share, len(h))
    h = h.reshape(CELLS + 2, CELLS + 2, BINS)[1:-1, 1:-1].ravel()
    size = np.linalg.norm(h)
    if not size:
        return None
    h = np.minimum(h / size, 0.2)
    return np.minimum(np.rint(512 * h / np.linalg.norm(h)), 255.0)


_FEATURE = "image_id string, feature_id long, y double, x double, size double, angle double, response double, d array<double>"


def describe(octaves: DataFrame, keys: DataFrame, side: int = blocks.SIDE) -> DataFrame:
    """image_id, feature_id, y, x, size (in cells of the image), angle, response and descriptor d of each keypoint and orientation.

    feature_id is made of octave, level, cell and orientation, so it does not depend on the partitions.
    """
    places = keys.select(F.concat(F.col("octave").cast("string"), F.lit(":"), "image_id").alias("image_id"), F.floor(F.col("ri") / side).alias("ty"), F.floor(F.col("ci") / side).alias("tx"),
                         F.struct("level", "ri", "ci", "y", "x", "scale", "response").alias("key"))
    # at most one keypoint a cell and level, so a block's list is bounded
    lists = places.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    widest = SIGMA * 2 ** ((SCALES + 0.5) / SCALES)
    halo = _reach_of_descriptor(widest) + max(reach(o, SCALES) for o in (0, 1)) + 2

    def run(groups):
        out = []
        for group, sides in groups:
            octave, name = _octave_of(group.split("|", 2)[2])
            r0, c0, cells, note = sides[0]
            grads, k2 = {}, 2.0**octave
            for key in json.loads(note):
                s = key["level"]
                if s not in grads:
                    grads[s] = np.gradient(blurred(cells, deviations(octave)[s]))
                gy, gx = grads[s]
                y, x, scale = key["y"] - r0, key["x"] - c0, key["scale"]
                for k, angle in enumerate(_orientations(gx, gy, y, x, scale)):
                    d = _descriptor(gx, gy, y, x, scale, angle)
                    if d is not None:
                        # 5 bits of orientation, 24 each of cell, 2 of level, 4 of octave
                        where = (((octave << 2 | s) << 24 | key["ri"]) << 24 | key["ci"]) << 5 | k
                        out.append((name, where, key["y"] * k2, key["x"] * k2, scale * k2, angle, key["response"], d))
        if out:
            kinds = (pa.string(), pa.int64(), *(pa.float64(),) * 5, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["image_id", "feature_id", "y", "x", "size", "angle", "response", "d"])

    boxes = _boxes(lists, side, halo, F.encode(F.to_json("keys"), "UTF-8"))
    return blocks.over_boxes(blocks.pieces(octaves, boxes, side), run, _FEATURE)


def of_blocks(tiled: DataFrame, span: float = 255.0, octaves: int = 4, most: int = 4000, contrast: float = CONTRAST, side: int = blocks.SIDE) -> DataFrame:
    """Features of the most strongest keypoints of each image of a block raster."""
    levels = pyramid(tiled, octaves, side)
    return written(describe(levels, written(strongest(keypoints(levels, span, contrast, side=side), most), "keypoints"), side), "features")


#: Tilts of the simulated views; a tilt's turns lie 72 degrees over the tilt apart.
TILTS = (1.0, math.sqrt(2), 2.0, 2 * math.sqrt(2))


def view_table(tilts: tuple[float, ...] = TILTS) -> list[tuple[int, float, float]]:
    """view, tilt and turn in degrees."""
    turns = [(t, p) for t in tilts for p in ([0.0] if t == 1.0 else np.arange(0, 180, 72.0 / t).tolist())]
    return [(k, t, p) for k, (t, p) in enumerate(turns)]


def placed_views(sizes: DataFrame, views: list[tuple[int, float, float]]) -> DataFrame:
    """image_id, view, tilt, cosine and sine of the turn, first corner x0, y0 and size w2, h2 of the turned image, for each image(h, w) and view."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("view"), F.lit(t).alias("tilt"), F.lit(math.cos(math.radians(p))).alias("cos"), F.lit(math.sin(math.radians(p))).alias("sin"), F.lit(p == 0).alias("flat")) for k, t, p in views)))
    v = sizes.withColumn("t", rows).select("image_id", "h", "w", "t.*")
    zero = F.lit(0)
    x = [zero, (F.col("cos") * F.col("w")).cast("int"), (F.col("cos") * F.col("w") - F.col("sin") * F.col("h")).cast("int"), (-F.col("sin") * F.col("h")).cast("int")]
    y = [zero, (F.col("sin") * F.col("w")).cast("int"), (F.col("sin") * F.col("w") + F.col("cos") * F.col("h")).cast("int"), (F.col("cos") * F.col("h")).cast("int")]
    flat = lambda a, b: F.when(F.col("flat"), a).otherwise(b).cast("int")
    return v.select(
        "image_id", "view", "tilt", "cos", "sin", flat(zero, F.least(*x)).alias("x0"), flat(zero, F.least(*y)).alias("y0"),
        flat(F.col("w"), F.greatest(*x) - F.least(*x) + 1).alias("w2"), flat(F.col("h"), F.greatest(*y) - F.least(*y) + 1).alias("h2"),
    )


def _blur_of(tilt: float) -> np.ndarray:
    if tilt == 1.0:
        return np.ones(1)
    sigma = 0.8 * math.sqrt(tilt * tilt - 1)
    half = max(1, round(3 * sigma))
    return np.exp(-np.arange(-half, half + 1) ** 2.0 / (2 * sigma * sigma))


def view_blocks(tiled: DataFrame, placed: DataFrame, outside: float = math.nan, side: int = blocks.SIDE) -> DataFrame:
    """All placed views of a block raster as one block raster, image_id "view:image".

    Turned about the origin (bilinear), blurred along rows by 0.8 sqrt(tilt^2 - 1) (mirrored), squashed to a tilt-th of
    the width by nearest columns, as training.skew_view does; but outside is no data unless a value is given, so that
    a view's frame makes no features, and blocks that see nothing of the image are left out. A block of a view is one
    box of the image, whatever the number of views.
    """
    width = F.greatest(F.lit(1), F.rint(F.col("w2") / F.col("tilt")).cast("int"))
    v = placed.withColumn("out", width)
    v = v.withColumn("ty", F.explode(F.sequence(F.lit(0), F.floor((F.col("h2") - 1) / side).cast("int")))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor((F.col("out") - 1) / side).cast("int"))))
    half = F.when(F.col("tilt") == 1.0, 0).otherwise(F.greatest(F.lit(1), F.rint(2.4 * F.sqrt(F.col("tilt") * F.col("tilt") - 1)).cast("int")))
    # the part of the turned image behind a block, then the box of the image behind that part
    v = v.withColumn("ca", F.greatest(F.lit(0), F.floor(F.col("tx") * side * F.col("tilt")).cast("int") - half)).withColumn("ra", F.col("ty") * side)
    v = v.withColumn("cb", F.least(F.col("w2") - 1, F.floor((F.col("tx") + 1) * side * F.col("tilt")).cast("int") + half)).withColumn("rb", F.least(F.col("h2"), (F.col("ty") + 1) * side) - 1)
    px, py = ([F.col(a) + F.col("x0") for a in ("ca", "cb")], [F.col(a) + F.col("y0") for a in ("ra", "rb")])
    sx, sy = ([f(x, y) for x in px for y in py] for f in (lambda x, y: F.col("cos") * x + F.col("sin") * y, lambda x, y: F.col("cos") * y - F.col("sin") * x))
    v = v.select(
        "*", (F.floor(F.least(*sy)) - 1).cast("int").alias("r0"), (F.floor(F.least(*sx)) - 1).cast("int").alias("c0"),
        (F.floor(F.greatest(*sy)) + 3).cast("int").alias("re"), (F.floor(F.greatest(*sx)) + 3).cast("int").alias("ce"),
    )
    note = F.encode(F.to_json(F.struct("tilt", "cos", "sin", "x0", "y0", "w2", "h2", "out", "ca", "cb", "ra", "rb")), "UTF-8")
    boxes = v.select(
        F.concat_ws("|", F.col("ty").cast("string"), F.col("tx").cast("string"), F.concat(F.col("view").cast("string"), F.lit(":"), "image_id")).alias("group"), F.lit(0).alias("side"), "image_id",
        "r0", "c0", (F.col("re") - F.col("r0")).alias("h"), (F.col("ce") - F.col("c0")).alias("w"), note.alias("note"),
    )

    def run(groups):
        rows = []
        for group, sides in groups:
            ty, tx, image = group.split("|", 2)
            r0, c0, cells, note = sides[0]
            n = json.loads(note)
            cells = cells if math.isnan(outside) else np.where(np.isnan(cells), outside, cells)
            turned = _turned(cells, r0, c0, n, outside)
            o = np.arange(int(tx) * side, min(n["out"], (int(tx) + 1) * side))
            seen = _squashed(turned, n, o)
            r, c = np.nonzero(~np.isnan(seen))
            if len(r):
                h, w = int(r.max()) + 1, int(c.max()) + 1
                rows.append((image, int(ty), int(tx), int(ty) * side, int(tx) * side, h, w, np.ascontiguousarray(seen[:h, :w]).tobytes()))
        if rows:
            yield blocks._rows(rows)

    return blocks.over_boxes(blocks.pieces(tiled, boxes, side), run, blocks.SCHEMA)


def _turned(cells: np.ndarray, r0: int, c0: int, n: dict, outside: float) -> np.ndarray:
    """The part ra..rb, ca..cb of the turned image; a weight of zero asks for no cell."""
    py, px = np.meshgrid(np.arange(n["ra"], n["rb"] + 1) + n["y0"], np.arange(n["ca"], n["cb"] + 1) + n["x0"], indexing="ij")
    sx, sy = np.round(n["cos"] * px + n["sin"] * py, 9), np.round(n["cos"] * py - n["sin"] * px, 9)
    x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x, sy - y
    out = np.zeros(sx.shape)
    for i in (0, 1):
        for j in (0, 1):
            k = (fy if i else 1 - fy) * (fx if j else 1 - fx)
            r, c = y + i - r0, x + j - c0
            inside = (r >= 0) & (r < cells.shape[0]) & (c >= 0) & (c < cells.shape[1])
            tap = np.where(inside, cells[np.clip(r, 0, cells.shape[0] - 1), np.clip(c, 0, cells.shape[1] - 1)], outside)
            out += np.where(k > 0, k * tap, 0.0)
    return out


def _squashed(turned: np.ndarray, n: dict, o: np.ndarray) -> np.ndarray:
    at = np.minimum(np.floor(o * n["tilt"]).astype(int), n["w2"] - 1)
    weights, period = _blur_of(n["tilt"]), max(1, 2 * (n["w2"] - 1))
    half = len(weights) // 2
    top, low = np.zeros((len(turned), len(o))), np.zeros((len(turned), len(o)))
    for d, k in enumerate(weights):
        folded = (at + d - half) % period
        part = turned[:, np.minimum(folded, period - folded) - n["ca"]]
        seen = ~np.isnan(part)
        top += k * np.where(seen, part, 0.0)
        low += k * seen
    whole = ~np.isnan(turned[:, at - n["ca"]])
    out = np.full(top.shape, np.nan)
    np.divide(top, low, out=out, where=whole)
    return out


def of_views(tiled: DataFrame, span: float = 255.0, tilts: tuple[float, ...] = TILTS, octaves: int = 4, most: int = 4000, contrast: float = CONTRAST, side: int = blocks.SIDE) -> DataFrame:
    """Features of all simulated views of each image, at their places in the image itself; most of each view."""
    sizes = tiled.groupBy("image_id").agg(F.max(F.col("r0") + F.col("h")).alias("h"), F.max(F.col("c0") + F.col("w")).alias("w"))
    placed = written(placed_views(sizes, view_table(tilts)), "views")
    seen = of_blocks(written(view_blocks(tiled, placed, side=side), "view_blocks"), span, octaves, most, contrast, side)
    return back_projected(seen, placed)


def back_projected(seen: DataFrame, placed: DataFrame) -> DataFrame:
    """Features of "view:image" rasters at their places in the image; the view is in feature_id's upper five bits."""
    view = F.substring_index("image_id", ":", 1).cast("int")
    tagged = seen.withColumn("view", view).withColumn("image_id", F.expr("substr(image_id, instr(image_id, ':') + 1)"))
    both = tagged.join(placed.select("image_id", "view", "tilt", "cos", "sin", "x0", "y0"), ["image_id", "view"])
    px, py = F.col("x") * F.col("tilt") + F.col("x0"), F.col("y") + F.col("y0")
    return both.select(
        "image_id", F.col("feature_id").bitwiseOR(F.shiftleft(F.col("view").cast("long"), 59)).alias("feature_id"),
        (F.col("cos") * py - F.col("sin") * px).alias("y"), (F.col("cos") * px + F.col("sin") * py).alias("x"), "size", "angle", "response", "d",
    )


def match(a: DataFrame, b: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Matches of the features of images with one image_id: pair_id, match_id, xa, ya, xb, yb, conf = 1 - d1 / d2.

    Each feature of a takes its nearest of b if that is nearer than ratio times the second. Both sides of a pair are dealt into blocks of bounded
    size, and a pair of blocks is one matrix product; an image with fewer than two features in b has no matches. Matches that join
    the same cells (as from several views) come once, the best of them, then that of the smallest feature_id.
    """
    counts = a.groupBy("image_id").agg(F.count("*").alias("n")).join(b.groupBy("image_id").agg(F.count("*").alias("m")), "image_id")
    lots = written(counts.select("image_id", *(F.ceil(F.col(c) / matching.BLOCK).cast("int").alias(c) for c in ("n", "m"))), "lots")

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        block = F.pmod(F.xxhash64("feature_id"), F.col(own)).cast("int").alias(i)
        # names of its own, as both sides may come of one relation
        return df.join(lots, "image_id").select(*(F.col(c).alias(c) for c in ("image_id", "feature_id", "d", "x", "y")), block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j))

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame(columns=["pair_id", "qid", "xa", "ya", "tid", "xb", "yb", "d"]).astype({"pair_id": str, "qid": "int64", "tid": "int64", **{c: float for c in ("xa", "ya", "xb", "yb", "d")}})
        rows, cols, d = matching._nearest_two(np.stack(q["d"].to_numpy()), np.stack(t["d"].to_numpy()), t["feature_id"].to_numpy(np.int64), False)
        q, t = q.iloc[rows], t.iloc[cols]
        return pd.DataFrame({"pair_id": q["image_id"].to_numpy(), "qid": q["feature_id"].to_numpy(), "xa": q["x"].to_numpy(), "ya": q["y"].to_numpy(),
                             "tid": t["feature_id"].to_numpy(), "xb": t["x"].to_numpy(), "yb": t["y"].to_numpy(), "d": d})

    sides = (dealt(a, "n", "m", "i", "j").groupBy("image_id", "i", "j"), dealt(b, "m", "n", "j", "i").groupBy("image_id", "i", "j"))
    near = sides[0].cogroup(sides[1]).applyInPandas(search, "pair_id string, qid long, xa double, ya double, tid long, xb double, yb double, d double")
    place = Window.partitionBy("pair_id", "qid").orderBy("d", "tid")
    two = near.withColumn("k", F.row_number().over(place)).where("k <= 2").groupBy("pair_id", "qid", "xa", "ya").agg(
        F.min_by(F.struct("xb", "yb", "d"), "k").alias("one"), F.max("d").alias("d2"), F.count("*").alias("n")
    )
    good = two.where((F.col("n") == 2) & (F.col("one.d") < ratio * F.col("d2")))
    found = good.select("pair_id", F.col("qid").alias("match_id"), "xa", "ya", F.col("one.xb").alias("xb"), F.col("one.yb").alias("yb"), (1 - F.col("one.d") / F.col("d2")).alias("conf"))
    best = F.min_by(F.struct("match_id", "xa", "ya", "xb", "yb", "conf"), F.struct(-F.col("conf"), F.col("match_id")))
    return found.groupBy("pair_id", *(F.rint(c).alias(f"at_{c}") for c in ("xa", "ya", "xb", "yb"))).agg(best.alias("m")).select("pair_id", "m.*")
