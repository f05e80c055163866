"""Geodesy and projection: distances, polynomial geolocation, target grids, nearest samples, warps and lattices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.config import DEFAULT
from regolith.functions.tables import written
from regolith.operators import blocks
from regolith.operators.catalog import nearest_band
from regolith.operators.match_metrics import apply_model
from regolith.operators.raster import box_mean


def pixel_size_m(a: Column, identity: Column, crs: Column, geographic: Column, radius_m: float = DEFAULT.moon_radius_m) -> Column:
    """Metres of a pixel; NULL without a reference system or for an identity transform, degrees become metres."""
    return F.when(crs.isNull() | a.isNull() | F.coalesce(identity, F.lit(False)), F.lit(None).cast("double")).when(geographic, F.radians(F.abs(a)) * radius_m).otherwise(F.abs(a))


def scale_ratio(fine: Column, coarse: Column) -> Column:
    """coarse / fine; raises where fine is not positive."""
    return F.when(fine > 0, coarse / fine).otherwise(F.raise_error(F.lit("the fine ground sample distance must be positive")).cast("double"))


def arc_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float = DEFAULT.moon_radius_m) -> Column:
    """Great-circle distance by the haversine."""
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius_m * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))))


def ground_gsd(backplane: DataFrame) -> DataFrame:
    """image_id, gsd_m: end-to-end width of each line over its steps, averaged over lines; backplane(image_id, r, c, lat, lon).

    End to end, not neighbour to neighbour: quantised coordinates would make steps too long or zero.
    """
    ends = backplane.groupBy("image_id", "r").agg(
        F.min(F.struct("c", "lat", "lon")).alias("a"), F.max(F.struct("c", "lat", "lon")).alias("b")
    ).where(F.col("b.c") > F.col("a.c"))
    width = arc_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) / (F.col("b.c") - F.col("a.c"))
    return ends.groupBy("image_id").agg(F.avg(width).alias("gsd_m"))


def terms(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def fit_inverse(geoloc: DataFrame, degree: int = 1) -> dict:
    """Least-squares polynomials (lon, lat) -> (pixel, scan) on centred, uncorrelated, scaled coordinates.

    Down a long, narrow strip lon and lat nearly lie on a line: of lat only what lon does not tell (my + slope (lon - mx))
    is a coordinate, so that the Gram matrix stays well conditioned whatever the strip's length. One pass sums the Gram matrix; only that small matrix is solved by the driver. Returns the model
    with its RMS residual in pixels. An empty table, and one whose samples do not determine the polynomials
    (fewer than its terms, or all on a line), raise ValueError.
    """
    s = geoloc.agg(
        F.avg("lon").alias("mx"), F.avg("lat").alias("my"), F.var_pop("lon").alias("xx"), F.var_pop("lat").alias("yy"), F.covar_pop("lon", "lat").alias("xy")
    ).first()
    if s["mx"] is None:
        raise ValueError("no sample with coordinates")
    slope = s["xy"] / s["xx"] if s["xx"] else 0.0
    rest = s["yy"] - slope * s["xy"]
    # what rounding leaves of samples on a line is no spread
    sy = math.sqrt(rest) if rest > 1e-12 * s["yy"] else math.sqrt(s["yy"])
    model = {"degree": degree, "mx": s["mx"], "my": s["my"], "slope": slope, "sx": math.sqrt(s["xx"]) or 1.0, "sy": sy or 1.0}
    t = terms(degree)
    base = geoloc.select(*(e.alias(f"t{i}") for i, e in enumerate(_design(model))), "pixel", "scan")
    pairs = [(i, j) for i in range(len(t)) for j in range(i, len(t))]
    row = base.agg(
        *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"g{i}_{j}") for i, j in pairs),
        *(F.sum(F.col(f"t{i}") * F.col(k)).alias(f"{k}{i}") for i in range(len(t)) for k in ("pixel", "scan")),
    ).first()
    gram = np.zeros((len(t), len(t)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    if np.linalg.matrix_rank(gram, hermitian=True) < len(t):
        raise ValueError(f"the samples do not determine polynomials of degree {degree}")
    for k in ("pixel", "scan"):
        model[k] = np.linalg.solve(gram, np.array([row[f"{k}{i}"] for i in range(len(t))])).tolist()
    px, py = apply_inverse(model)
    model["rms"] = geoloc.agg(F.sqrt(F.avg(F.pow(px - F.col("pixel"), F.lit(2)) + F.pow(py - F.col("scan"), F.lit(2))))).first()[0]
    return model


def _design(model: dict) -> list[Column]:
    x, y = F.col("lon") - model["mx"], F.col("lat") - model["my"]
    x, y = x / model["sx"], (y - model["slope"] * x) / model["sy"]
    return [F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) for i, j in terms(model["degree"])]


def apply_inverse(model: dict) -> tuple[Column, Column]:
    """Pixel and scan of the columns lon and lat."""
    total = lambda k: sum((F.lit(float(w)) * e for w, e in zip(model[k], _design(model), strict=True)), F.lit(0.0))
    return total("pixel"), total("scan")


def target_grid(spark: SparkSession, west: float, south: float, east: float, north: float, gsd_m: float, radius_m: float = DEFAULT.moon_radius_m) -> DataFrame:
    """North-up grid (r, c, lon, lat) of cell centres, steps in degrees of the ground sample distance."""
    step = math.degrees(gsd_m / radius_m)
    width, height = max(1, round((east - west) / step)), max(1, round((north - south) / step))
    cells = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    return cells.select("r", "c", (west + (F.col("c") + 0.5) * step).alias("lon"), (north - (F.col("r") + 0.5) * step).alias("lat"))


def project(pixels: DataFrame, models: dict[str, dict], grid: DataFrame, smooth: int = 1) -> DataFrame:
    """Each image (a strip) sampled on the grid by its own inverse at the nearest (pixel, scan), 0 outside.

    models has an inverse for each image_id. smooth > 1 averages an odd box before.
    """
    if smooth > 1:
        k = smooth if smooth % 2 else smooth + 1
        pixels = box_mean(pixels, k).select("image_id", "r", "c", F.col("mean_v").alias("v"))
    at = None
    for image_id, model in models.items():
        px, py = apply_inverse(model)
        own = grid.select(F.lit(image_id).alias("image_id"), F.col("r").alias("gr"), F.col("c").alias("gc"), F.rint(py).cast("int").alias("r"), F.rint(px).cast("int").alias("c"))
        at = own if at is None else at.unionAll(own)
    met = at.join(pixels.select("image_id", "r", "c", "v"), ["image_id", "r", "c"], "left")
    return met.select("image_id", F.col("gr").alias("r"), F.col("gc").alias("c"), F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNotNull().alias("valid"))


def nearest_sample(points: DataFrame, samples: DataFrame, radius: float) -> DataFrame:
    """For each point(id, x, y) the nearest sample(sid, sx, sy) within the radius: id, sid, d. Ties go to the smaller sid.

    Samples are laid in cells of the radius's size; a point looks into its own and the eight around.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    look = points.withColumn("o", F.explode(around)).select("id", "x", "y", (cell("x") + F.col("o.i")).alias("kx"), (cell("y") + F.col("o.j")).alias("ky"))
    laid = samples.select("sid", "sx", "sy", cell("sx").alias("kx"), cell("sy").alias("ky"))
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    near = look.join(laid, ["kx", "ky"]).withColumn("d", F.round(d, 9)).where(F.col("d") <= radius)
    return near.groupBy("id").agg(F.min(F.struct("d", "sid")).alias("b")).select("id", F.col("b.sid").alias("sid"), F.col("b.d").alias("d"))


def strip_bounds(geoloc: DataFrame) -> DataFrame:
    return geoloc.groupBy("image_id").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def pixel_latlon(row: Column, col: Column, transform: list[float], radius_m: float = DEFAULT.moon_radius_m) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a cell of a projected raster in metres (affine a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    x, y = a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f
    return F.degrees(y / radius_m), F.degrees(x / radius_m)


def swath_centre(probes: DataFrame) -> DataFrame:
    """Line through the centres of imaged columns of probe rows(image_id, r, c, v): slope, intercept, half of the least width."""
    rows = probes.where(F.col("v") > 0).groupBy("image_id", "r").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    mid = (F.col("a") + F.col("b")) / 2
    return rows.groupBy("image_id").agg(F.regr_slope(mid, F.col("r")).alias("slope"), F.regr_intercept(mid, F.col("r")).alias("intercept"), F.floor(F.min(F.col("b") - F.col("a")) / 2).alias("half"))


def lattice(spark: SparkSession, size: int, step: int, offset: float) -> DataFrame:
    """Points offset, offset + step, ... below size along both axes: k, x, y in row order."""
    n = max(0, math.ceil((size - offset) / step))
    return spark.range(n * n).select(F.col("id").alias("k"), (offset + (F.col("id") % n) * step).cast("double").alias("x"), (offset + F.floor(F.col("id") / n) * step).cast("double").alias("y"))


def correspondences(points: DataFrame, size: int, mask: DataFrame | None = None) -> DataFrame:
    """points(x, y, m) with their images bx, by under m that lie inside (and on valid mask cells r, c)."""
    bx, by = apply_model(F.col("x"), F.col("y"), F.col("m"))
    out = points.withColumn("bx", bx).withColumn("by", by).where((F.col("bx") >= 0) & (F.col("bx") < size) & (F.col("by") >= 0) & (F.col("by") < size))
    if mask is not None:
        out = out.withColumn("r", F.col("by").cast("int")).withColumn("c", F.col("bx").cast("int")).join(mask, ["r", "c"], "left_semi").drop("r", "c")
    return out


def coarse_assignment(cells: DataFrame, size: int, stride: int = 8) -> DataFrame:
    """cells(i, m) with j, the coarse cell into which the centre of cell i maps; cells that map outside are left out."""
    g = size // stride
    x, y = (F.col("i") % g + 0.5) * stride, (F.floor(F.col("i") / g) + 0.5) * stride
    bx, by = apply_model(x, y, F.col("m"))
    placed = cells.withColumn("cj", F.floor(bx / stride)).withColumn("ri", F.floor(by / stride))
    return placed.where(F.col("cj").between(0, g - 1) & F.col("ri").between(0, g - 1)).withColumn("j", F.col("ri") * g + F.col("cj")).drop("cj", "ri")


def tilt_curriculum(ids: DataFrame, max_tilt: float = 45.0) -> DataFrame:
    """ids(id from 0) with tilt_deg: the first half within 0-15 degrees, the rest from 15 to max_tilt, by the fixed key."""
    n = ids.agg(F.max("id").alias("last"))
    u = F.pmod(F.col("id") * 1103515245 + 12345, F.lit(2147483648)) / 2147483648.0
    return ids.join(F.broadcast(n)).select("id", F.when(F.col("id") * 2 < F.col("last") + 1, u * 15).otherwise(15 + u * (max_tilt - 15)).alias("tilt_deg"))


def perspective_homography(size: int, tilt_deg: float, azimuth_rad: float, rotation_deg: float = 0.0, scale: float = 1.0, focal_ratio: float = 3.0) -> np.ndarray:
    """Homography of a ground plane tilted about an axis in the plane, seen by a pinhole camera at focal_ratio sizes."""
    from regolith.operators.fitting import homography_of

    t, d, half = math.radians(tilt_deg), focal_ratio * size, size / 2
    corners = np.array([[-half, -half], [half, -half], [half, half], [-half, half]])
    axis = np.array([math.cos(azimuth_rad), math.sin(azimuth_rad), 0.0])
    p = np.c_[corners, np.zeros(4)]
    turned = p * math.cos(t) + np.cross(axis, p) * math.sin(t) + np.outer(p @ axis, axis) * (1 - math.cos(t))
    seen = d * turned[:, :2] / (turned[:, 2:] + d)
    r = math.radians(rotation_deg)
    seen = seen @ np.array([[math.cos(r), math.sin(r)], [-math.sin(r), math.cos(r)]]) * scale
    return homography_of(corners + half, seen + half)


#: Fixed value: sharpness of the cubic kernel.
CUBIC = -0.75
#: Cells of a raster that one part of a warped image may be made from.
SOURCE_CELLS = 1 << 18


def _places(m: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the source (row, column) the cells of a warped image come from, by model m; NaN where nowhere."""
    a = m.reshape(3, 3)
    # adjugate: the inverse up to a factor, which the perspective division takes out
    i = np.array([np.cross(a[:, 1], a[:, 2]), np.cross(a[:, 2], a[:, 0]), np.cross(a[:, 0], a[:, 1])])
    x, y = c.astype(float), r.astype(float)
    with np.errstate(all="ignore"):
        w = i[2, 0] * x + i[2, 1] * y + i[2, 2]
        sy, sx = (i[1, 0] * x + i[1, 1] * y + i[1, 2]) / w, (i[0, 0] * x + i[0, 1] * y + i[0, 2]) / w
    sy, sx = (np.where(np.isfinite(v), v, np.nan) for v in (sy, sx))
    return np.round(sy, 9), np.round(sx, 9)


def _warp_boxes(m: np.ndarray, place: tuple[int, int, int, int], rows: int, cols: int) -> Iterator[tuple[tuple, tuple]]:
    """Parts (r0, c0, h, w) of a place of the warped image, and the source box that each needs, empty for none; cut until boxes are small."""
    r0, c0, h, w = place
    r, c = (v.ravel() for v in np.mgrid[r0 : r0 + h, c0 : c0 + w])
    sy, sx = _places(m, r, c)
    on = (sy > -3) & (sy < rows + 2) & (sx > -3) & (sx < cols + 2)
    if not on.any():
        yield place, (0, 0, 0, 0)
        return
    top, left = max(int(np.floor(sy[on].min())) - 1, 0), max(int(np.floor(sx[on].min())) - 1, 0)
    bottom, right = min(int(np.floor(sy[on].max())) + 3, rows), min(int(np.floor(sx[on].max())) + 3, cols)
    if bottom <= top or right <= left:
        yield place, (0, 0, 0, 0)
        return
    if (bottom - top) * (right - left) <= SOURCE_CELLS or h * w == 1:
        yield place, (top, left, bottom - top, right - left)
        return
    for p, q in ((0, (h + 1) // 2), ((h + 1) // 2, h)):
        for u, v in ((0, (w + 1) // 2), ((w + 1) // 2, w)):
            if q > p and v > u:
                yield from _warp_boxes(m, (r0 + p, c0 + u, q - p, v - u), rows, cols)


def _tap_weights(d: np.ndarray, method: str) -> np.ndarray:
    """Weight of a cell at distance d."""
    d = np.abs(d)
    if method == "bilinear":
        return np.maximum(0, 1 - d)
    a = CUBIC
    return np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0.0))


def _sampled(box: tuple[int, int, np.ndarray], sy: np.ndarray, sx: np.ndarray, method: str) -> np.ndarray:
    """Values at the places from the cells of a box; cells that are not there, or have no data, count as 0."""
    top, left, grid = box
    out = np.zeros(len(sy))
    fine = np.flatnonzero(np.isfinite(sy) & np.isfinite(sx))
    sy, sx = sy[fine], sx[fine]
    known = np.nan_to_num(grid)

    def add(r, c, weight):
        i, j = r - top, c - left
        ok = (i >= 0) & (i < grid.shape[0]) & (j >= 0) & (j < grid.shape[1])
        out[fine[ok]] += (weight if np.isscalar(weight) else weight[ok]) * known[i[ok].astype(int), j[ok].astype(int)]

    if method == "nearest":
        add(np.rint(sy), np.rint(sx), 1.0)
        return out
    span = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
    for i in span:
        for j in span:
            r, c = np.floor(sy) + i, np.floor(sx) + j
            add(r, c, _tap_weights(sx - c, method) * _tap_weights(sy - r, method))
    return out


def warp(pixels: DataFrame, models: DataFrame, height: int, width: int, method: str = "cubic") -> DataFrame:
    """Each image under its model(image_id, m): nearest, bilinear or cubic (a = -0.75) sampling, 0 outside and without data.

    The warped image is dealt in blocks; each names the box of the source that it is made from and gets it from the
    blocks of the source. A block that a strong perspective spreads over the source is cut into parts of small boxes.
    """
    tiled = written(blocks.to_blocks(pixels), "blocks")
    size = tiled.groupBy("image_id").agg(F.max(F.col("r0") + F.col("h")).alias("rows"), F.max(F.col("c0") + F.col("w")).alias("cols"))
    down, across = -(-height // blocks.SIDE), -(-width // blocks.SIDE)
    wanted = models.select(F.col("image_id").cast("string").alias("image_id"), "m", F.explode(F.sequence(F.lit(0), F.lit(down * across - 1))).alias("k")).join(size, "image_id", "left").repartition("image_id", "k")

    def place_of(k: int) -> tuple[int, int, int, int]:
        r0, c0 = k // across * blocks.SIDE, k % across * blocks.SIDE
        return r0, c0, min(blocks.SIDE, height - r0), min(blocks.SIDE, width - c0)

    def name_boxes(batches):
        for batch in batches:
            for image, m, k, rows, cols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, place = np.array(m, float), place_of(k)
                parts = [(place, (0, 0, 0, 0))] if rows is None else _warp_boxes(m, place, rows, cols)
                out = [(f"{k}|{n}|{image}", 0, image, *box, np.concatenate((m, part)).tobytes()) for n, (part, box) in enumerate(parts)]
                kinds = (pa.string(), pa.int32(), pa.string(), *(pa.int32(),) * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in blocks.BOX.split(", ")])

    boxes = written(wanted.select("image_id", "m", "k", "rows", "cols").mapInArrow(name_boxes, blocks.BOX), "boxes")

    def cells_of(image: str, note: bytes, box: tuple | None) -> pa.RecordBatch:
        told = np.frombuffer(note)
        r0, c0, h, w = told[9:].astype(int)
        r, c = (v.ravel() for v in np.mgrid[r0 : r0 + h, c0 : c0 + w])
        return blocks.cell_batch([image] * len(r), r, c, np.zeros(len(r)) if box is None else _sampled(box, *_places(told[:9], r, c), method))

    def fill(groups):
        for name, sides in groups:
            yield cells_of(name.split("|", 2)[2], sides[0][3], sides[0][:3])

    def leave(batches):
        for batch in batches:
            for image, note in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield cells_of(image, note, None)

    out = "image_id string, r int, c int, v double"
    filled = blocks.over_boxes(blocks.pieces(tiled, boxes), fill, out)
    some = blocks.met_blocks(boxes).join(tiled.select("image_id", "ty", "tx"), ["image_id", "ty", "tx"], "left_semi").select("group").distinct()
    empty = boxes.join(some, "group", "left_anti").select("image_id", "note").mapInArrow(leave, out)
    return filled.unionByName(empty)


def chunks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Per image(image_id, height) n evenly spaced chunks of size rows: chunk, row0."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk")
    row0 = F.floor(F.greatest(F.lit(0), F.col("height") - size) * F.col("chunk") / F.lit(max(n - 1, 1)))
    return rows.select("image_id", "height", k).select("image_id", "chunk", row0.cast("int").alias("row0"))


def lines_in_tile(backplane: DataFrame, west: float, east: float, south: float, north: float, least: int = 128) -> DataFrame:
    """Per image(image_id, r, c, lat, lon): first and last line whose middle sample lies in the tile, and how many do, where at least so many do."""
    middle = backplane.groupBy("image_id").agg(F.floor((F.max("c") + 1) / 2).cast("int").alias("mid"))
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    lines = backplane.join(middle, "image_id").where((F.col("c") == F.col("mid")) & inside)
    return lines.groupBy("image_id").agg(F.min("r").alias("first"), F.max("r").alias("last"), F.count("*").alias("lines")).where(F.col("lines") >= least)


def band_lines(cube: DataFrame, bands: DataFrame, backplane: DataFrame, nm: float, south: float, north: float, mirrored: bool = False, least: int = 64) -> DataFrame:
    """image_id, r, c, v of the band of cube(image_id, band, r, c, v) nearest to a wavelength, from the lines between two latitudes.

    Lines run from the first to the last whose middle sample lies there and count from 0; cells without data are 0.
    mirrored turns columns round, for products that are stored so. Images with fewer than the least lines are left out.
    """
    lines = lines_in_tile(backplane, -360.0, 360.0, south, north, least).select("image_id", "first", "last")
    width = backplane.groupBy("image_id").agg((F.max("c") + 1).alias("width"))
    which = nearest_band(bands, nm).select("image_id", "band").join(lines, "image_id").join(width, "image_id")
    read = cube.join(which, ["image_id", "band"]).where(F.col("r").between(F.col("first"), F.col("last")))
    c = F.col("width") - 1 - F.col("c") if mirrored else F.col("c")
    return read.select("image_id", (F.col("r") - F.col("first")).alias("r"), c.alias("c"), F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("v"))


def valid_chunks(pixels: DataFrame, n: int, size: int, least: float = 0.5) -> DataFrame:
    """Of n row chunks spaced evenly down each image: row0 and the share of cells with data, where it reaches the least."""
    full = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    places = chunks(full.select("image_id", "height"), n, size).join(full, "image_id")
    rows = pixels.groupBy("image_id", "r").agg(F.count_if(F.col("v") > 0).alias("n"))
    touched = F.explode(F.sequence(F.floor(F.col("row0") / size), F.floor((F.col("row0") + size - 1) / size)))
    met = places.withColumn("b", touched).join(rows.withColumn("b", F.floor(F.col("r") / size)), ["image_id", "b"])
    met = met.where(F.col("r").between(F.col("row0"), F.col("row0") + size - 1))
    share = met.groupBy("image_id", "chunk", "row0", "width", "height").agg(F.sum("n").alias("n"))
    share = share.withColumn("share", F.col("n") / (F.least(F.lit(size), F.col("height")) * F.col("width")))
    return share.where(F.col("share") >= least).select("image_id", "chunk", "row0", "share")


def checked_latlon(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Both as they are; a latitude beyond the poles is an error, since the transform's units cannot be metres then."""
    wrong = F.raise_error(F.concat(F.lit("latitude out of range: "), lat.cast("string")))
    return F.when(lat.isNull() | (F.abs(lat) <= 90), lat).otherwise(wrong.cast("double")), lon


def strip_window(pixels: DataFrame, row: int, size: int, probe: int = 8) -> DataFrame:
    """Per image the corner (row0, col0) of a window centred on the imaged swath at a row, found from a few probe lines.

    Images whose probe has fewer imaged columns than the window are left out.
    """
    full = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    row0 = F.greatest(F.lit(0), F.least(F.lit(row), F.col("height") - size))
    lines = pixels.join(full.withColumn("row0", row0), "image_id").where((F.col("r") >= F.col("row0")) & (F.col("r") < F.col("row0") + probe))
    seen = lines.where(F.col("v") > 0).groupBy("image_id", "row0", "width").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count_distinct("c").alias("columns"))
    centre = F.floor((F.col("a") + F.col("b")) / 2) - size // 2
    col0 = F.greatest(F.lit(0), F.least(F.col("width") - size, centre)).cast("int")
    return seen.where(F.col("columns") >= size).select("image_id", "row0", col0.alias("col0"), "columns")


def reference_window(tiles: DataFrame, pixels: DataFrame, west: float, south: float, east: float, north: float, least: float = 0.5) -> DataFrame:
    """r, c, v of the box read from the first of tiles(image_id, west, north, step) whose data fill over the least share; 0 where it has none.

    The box is a grid of the tile's steps; cells past the tile's edge are cells without data.
    """
    w, h = F.rint(F.lit(east - west) / F.col("step")).cast("int"), F.rint(F.lit(north - south) / F.col("step")).cast("int")
    base = tiles.select("image_id", w.alias("w"), h.alias("h"), F.rint((F.col("north") - north) / F.col("step")).cast("int").alias("r0"), F.rint((west - F.col("west")) / F.col("step")).cast("int").alias("c0"))
    read = pixels.join(base, "image_id").where((F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + F.col("h")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + F.col("w")))
    share = read.groupBy("image_id", "w", "h", "r0", "c0").agg((F.count_if(F.col("v") > 0) / (F.col("w") * F.col("h"))).alias("share")).where(F.col("share") > least)
    first = share.agg(F.min(F.struct("image_id", "w", "h", "r0", "c0")).alias("t")).select("t.*").where(F.col("image_id").isNotNull())
    rows = first.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("r"))
    grid = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    have = read.select("image_id", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "v")
    return grid.select("image_id", "r", "c").join(have, ["image_id", "r", "c"], "left").select("image_id", "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def degree_sweep(geoloc: DataFrame, grid: DataFrame, height: int, width: int, degrees: tuple[int, ...] = (1, 2, 3, 4), most_rms: float = 5.0, least_fill: float = 0.1) -> DataFrame:
    """Per degree of the inverse: its RMS in pixels, the share of the grid that falls on the strip, and whether both are in their limits."""
    out = None
    for degree in degrees:
        model = fit_inverse(geoloc, degree)
        px, py = apply_inverse(model)
        on = F.rint(px).between(0, width - 1) & F.rint(py).between(0, height - 1)
        row = grid.agg(F.avg(on.cast("int")).alias("fill")).select(F.lit(degree).alias("degree"), F.lit(float(model["rms"])).alias("rms"), "fill")
        out = row if out is None else out.unionAll(row)
    return out.withColumn("passed", (F.col("rms") < most_rms) & (F.col("fill") > least_fill))
