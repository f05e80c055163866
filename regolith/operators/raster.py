"""Rasters as the relation pixels(image_id, r, c, v); NULL is no data, row 0 is north."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.config import DEFAULT
from regolith.functions.tables import written


def extent(pixels: DataFrame) -> DataFrame:
    """image_id, height, width."""
    return pixels.groupBy("image_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def _stretched(value: Column, lo: Column, hi: Column) -> Column:
    x = (value - lo) / F.greatest(hi - lo, F.lit(1e-6))
    # greatest and least pass over NULL, so no data is told apart first
    return F.when(x.isNull(), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255)).cast("int")


def quantiles(values: DataFrame, by: tuple[str, ...], probabilities: tuple[float, ...]) -> DataFrame:
    """by..., p: exact quantiles (interpolated between neighbours) of x in values(by..., x); NULL takes no part.

    No task sees a group as a whole: the values are sorted by ranges and written with their places, the groups'
    sizes in the ranges tell where each wanted rank lies, and those few places are read again.
    """
    v = values.where(F.col("x").isNotNull()).select(*by, "x")
    spread = written(v.sort(*by, "x").withColumn("at", F.monotonically_increasing_id()), "sorted")
    parts = spread.groupBy(*by, F.shiftrightunsigned("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    parts = parts.withColumn("upto", F.sum("n").over(whole.orderBy("range"))).withColumn("last", F.sum("n").over(whole) - 1)
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("q")) for i, p in enumerate(probabilities)))).alias("place")
    want = parts.select("*", places).select(*by, "first", "n", "upto", F.col("place.i").alias("i"), (F.col("place.q") * F.col("last")).alias("position"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("position").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("position").alias("rank")))).alias("s")
    want = want.select("*", sides).where((F.col("s.rank") < F.col("upto")) & (F.col("s.rank") >= F.col("upto") - F.col("n")))
    want = want.select((F.col("first") + F.col("s.rank") - F.col("upto") + F.col("n")).alias("at"), "i", "position", F.col("s.side").alias("side"))
    at = spread.join(want, "at")
    low, high = (F.max(F.when(F.col("side") == k, F.col("x"))) for k in (0, 1))
    between = (F.ceil("position") - F.col("position")) * F.col("low") + (F.col("position") - F.floor("position")) * F.col("high")
    each = at.groupBy(*by, "i", "position").agg(low.alias("low"), high.alias("high")).withColumn("value", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("p")).select(*by, F.col("p.value").alias("p"))


def stretch8(pixels: DataFrame, mask: Column | None = None, value: str = "v") -> DataFrame:
    """pixels with u in 0..255: stretched between the 1st and 99th percentile of the finite (and masked) values.

    No data, and images without any finite value, become 0.
    """
    pixels = written(pixels, "pixels")
    x = F.when(F.isnan(value) | (F.abs(F.col(value)) == float("inf")), F.lit(None)).otherwise(F.col(value))
    used = x if mask is None else F.when(mask, x)
    bounds = quantiles(pixels.select("image_id", used.alias("x")), ("image_id",), (0.01, 0.99))
    lo, hi = F.element_at("p", 1), F.element_at("p", 2)
    if mask is not None:  # a flat masked image keeps a range of one
        hi = F.when(hi <= lo, lo + 1).otherwise(hi)
    return pixels.join(bounds, "image_id", "left").withColumn("u", _stretched(x, lo, hi)).drop("p")


def _mirrored(pixels: DataFrame, axis: str, half: int) -> DataFrame:
    """pixels with the border of half cells along the axis mirrored without repeating the edge (reflect-101)."""
    last = F.max(axis).over(Window.partitionBy("image_id", "c" if axis == "r" else "r"))
    at = F.col(axis)
    copies = F.array(at, F.when((at >= 1) & (at <= half), -at), F.when((F.col("_last") - at >= 1) & (F.col("_last") - at <= half), 2 * F.col("_last") - at))
    padded = pixels.withColumn("_last", last).withColumn("_to", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    return padded.withColumn("_real", F.col("_to") == at).withColumn(axis, F.col("_to").cast("int")).drop("_to", "_last")


def box_mean(pixels: DataFrame, k: int, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """pixels with mean_<column> over k x k cells: one window over each row, then one over each column.

    k // 2 must be less than the image's height and width: smaller images raise an error.
    """
    half = k // 2
    side = extent(pixels)
    small = F.least("height", "width") <= half
    fits = side.select("image_id", F.when(small, F.raise_error(F.lit(f"an image is too small for a box of {k} cells"))).otherwise(F.lit(True)).alias("_fits"))
    out = pixels.join(fits, "image_id").where("_fits").drop("_fits")
    for axis, other in (("c", "r"), ("r", "c")):
        w = Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(-half, half)
        done = _mirrored(out, axis, half)
        for name in columns:
            source = name if axis == "c" else f"mean_{name}"
            done = done.withColumn(f"mean_{name}", F.avg(source).over(w))
        out = done.where("_real").drop("_real")
    return out


def local_contrast(pixels: DataFrame, k: int = DEFAULT.contrast_kernel) -> DataFrame:
    """(v - box mean) / box deviation (variance floored at 1e-6), stretched to u."""
    means = box_mean(pixels.withColumn("v2", F.col("v") * F.col("v")), k, ("v", "v2"))
    sd = F.sqrt(F.greatest(F.col("mean_v2") - F.col("mean_v") * F.col("mean_v"), F.lit(1e-6)))
    return stretch8(means.withColumn("contrast", (F.col("v") - F.col("mean_v")) / sd), value="contrast").select("image_id", "r", "c", "v", "contrast", "u")


def roll(pixels: DataFrame, rows: int = 0, columns: int = 0) -> DataFrame:
    """The raster moved down and right, wrapped around."""
    size = extent(pixels)
    moved = pixels.join(size, "image_id")
    return moved.select("image_id", F.pmod(F.col("r") + rows, "height").alias("r"), F.pmod(F.col("c") + columns, "width").alias("c"), "v")


def substitute(pixels: DataFrame, kind: str) -> DataFrame:
    """A raster of the same extent that holds no terrain: the mean, or normal noise of the same mean and deviation.

    The noise is Box-Muller over linear congruential numbers of the cell, so it is the same in every engine.
    """
    stats = pixels.groupBy("image_id").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), (F.max("c") + 1).alias("width"))
    cells = pixels.join(stats, "image_id")
    if kind == "constant":
        value = F.col("mu")
    else:
        cell = (F.col("r").cast("long") * F.col("width") + F.col("c")) * 2
        kept = lambda x: F.pmod(x, F.lit(2147483648))  # noqa: E731  # after each step, as the whole product passes 64 bits
        u = [kept(kept(kept(cell + i) * 1103515245 + 12345) * 69069 + 1) / 2147483648.0 for i in (1, 2)]
        value = F.col("mu") + F.col("sd") * F.sqrt(-2 * F.ln(F.greatest(u[0], F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * u[1])
    return cells.select("image_id", "r", "c", value.alias("v"))


def decimate(pixels: DataFrame, k: int) -> DataFrame:
    """Area average over k x k cells to height div k, width div k; exact where k divides both, else an area resample."""
    if k == 1:
        return pixels
    size = extent(pixels)
    return resample_to(pixels, size.select("image_id", "height", "width", F.floor(F.col("height") / k).cast("int").alias("h"), F.floor(F.col("width") / k).cast("int").alias("w")))


def block_means(pixels: DataFrame, k: int) -> DataFrame:
    """The mean of each block of k x k cells; where k does not divide a side, the last blocks are those cells that are left."""
    at = lambda axis: F.floor(F.col(axis) / k).cast("int").alias(axis)
    return pixels.groupBy("image_id", at("r"), at("c")).agg(F.avg("v").alias("v"))


def resample_area(pixels: DataFrame, factor: float) -> DataFrame:
    """Resampled to max(1, round(size / factor)) cells a side: area-weighted where it shrinks (factor over 1), cubic where it grows."""
    if abs(factor - 1) < 1e-6:
        return pixels
    if factor < 1:
        return resample_cubic(pixels, factor)
    size = extent(pixels)
    out = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) / factor).cast("int"))
    return resample_to(pixels, size.select("image_id", "height", "width", out("height").alias("h"), out("width").alias("w")))


def resample_to(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Area-weighted resample to h x w. Each cell goes to the few output cells that it overlaps, then sums are taken."""
    p = pixels.join(sizes, "image_id")

    def spread(df, axis, n, full):
        step = F.col(full) / F.col(n)  # input cells of an output cell
        first = F.floor(F.col(axis) / step + 1e-12)
        last = F.least(F.col(n) - 1, F.ceil((F.col(axis) + 1) / step - 1e-12) - 1)
        df = df.withColumn(f"o{axis}", F.explode(F.sequence(F.greatest(F.lit(0), F.least(first, last)).cast("int"), last.cast("int"))))
        o = F.col(f"o{axis}")
        return df.withColumn(f"w{axis}", F.least(F.col(axis) + 1, (o + 1) * step) - F.greatest(F.col(axis).cast("double"), o * step)).where(F.col(f"w{axis}") > 1e-12)

    p = spread(spread(p, "r", "h", "height"), "c", "w", "width")
    weight = F.col("wr") * F.col("wc")
    return p.groupBy("image_id", F.col("or").alias("r"), F.col("oc").alias("c")).agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("v"))


def cubic_weight(d: Column) -> Column:
    """Weight of a sample at distance d of the cubic kernel with a = -0.75."""
    x = F.abs(d)
    near = 1.25 * x * x * x - 2.25 * x * x + 1
    return F.when(x <= 1, near).when(x < 2, -0.75 * (x * x * x - 5 * x * x + 8 * x - 4)).otherwise(0.0)


def resample_cubic(pixels: DataFrame, factor: float) -> DataFrame:
    """Cubic interpolation between cell centres, the border cells repeated outwards; rows first, then columns."""
    out = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) / factor).cast("int"))
    sizes = extent(pixels).select("image_id", "height", "width", out("height").alias("h"), out("width").alias("w"))

    def along(df: DataFrame, axis: str, n: str, full: str) -> DataFrame:
        """The axis interpolated: every output cell takes four input cells, which it finds by their key."""
        other = "c" if axis == "r" else "r"
        step = F.col(full) / F.col(n)
        cells = sizes.select("image_id", n, full, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("o"))
        at = (F.col("o") + 0.5) * step - 0.5
        taps = cells.withColumn("at", at).withColumn("j", F.explode(F.array(*map(F.lit, (-1, 0, 1, 2))))).withColumn("k", (F.floor("at") + F.col("j")).cast("int"))
        taps = taps.select("image_id", "o", F.greatest(F.lit(0), F.least(F.col(full) - 1, F.col("k"))).cast("int").alias(axis), cubic_weight(F.col("at") - F.col("k")).alias("weight"))
        met = df.join(taps, ["image_id", axis])
        return met.groupBy("image_id", F.col("o").alias(axis), other).agg(F.sum(F.col("weight") * F.col("v")).alias("v"))

    return along(along(pixels.select("image_id", "r", "c", "v"), "r", "h", "height"), "c", "w", "width").select("image_id", "r", "c", "v")


def to_common_gsd(source: DataFrame, reference: DataFrame, source_gsd: float | None, reference_gsd: float | None):
    """Both rasters on the coarser grid, and the ratio; nothing is done for equal or unknown distances."""
    if not source_gsd or not reference_gsd or abs(source_gsd - reference_gsd) < 1e-9:
        return source, reference, 1.0
    if source_gsd < reference_gsd:
        return resample_area(source, reference_gsd / source_gsd), reference, reference_gsd / source_gsd
    return source, resample_area(reference, source_gsd / reference_gsd), reference_gsd / source_gsd


def upsample_nearest(pixels: DataFrame, k: int) -> DataFrame:
    """Each cell repeated k x k times."""
    grid = pixels.select("image_id", "r", "c", "v", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("i"))
    return grid.select("image_id", (F.col("r") * k + F.floor(F.col("i") / k)).cast("int").alias("r"), (F.col("c") * k + F.col("i") % k).cast("int").alias("c"), "v")


def window(pixels: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """The cells of a window, counted from its corner."""
    inside = F.col("r").between(row, row + height - 1) & F.col("c").between(col, col + width - 1)
    return pixels.where(inside).withColumn("r", F.col("r") - row).withColumn("c", F.col("c") - col)


def checked_window(pixels: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """window(), but an error where it passes the edge of an image (one pass over the places of the cells)."""
    size = extent(pixels)
    short = size.where((F.lit(row) < 0) | (F.lit(col) < 0) | (F.col("height") < row + height) | (F.col("width") < col + width)).orderBy("image_id").first()
    if short is not None:
        raise ValueError(f"{height} x {width} cells at ({row}, {col}) pass the edge of {short['image_id']}, {short['height']} x {short['width']}")
    return window(pixels, row, col, height, width)


def intersect_masks(fine: DataFrame, coarse: DataFrame, k: int) -> DataFrame:
    """Fine cells (image_id, r, c, valid) that are valid with the coarse cell (kr, kc) of their image."""
    own = fine.select("image_id", "r", "c", F.col("valid").alias("fine"), F.floor(F.col("r") / k).cast("int").alias("kr"), F.floor(F.col("c") / k).cast("int").alias("kc"))
    both = own.join(coarse.select("image_id", F.col("r").alias("kr"), F.col("c").alias("kc"), F.col("valid").alias("coarse")), ["image_id", "kr", "kc"])
    return both.select("image_id", "r", "c", "kr", "kc", (F.col("fine") & F.col("coarse")).alias("valid"))


def majority_mask(fine: DataFrame, k: int) -> DataFrame:
    """Coarse cells of each image, valid where most of their fine ones are."""
    return fine.groupBy("image_id", F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")).agg((F.avg(F.col("valid").cast("int")) > 0.5).alias("valid"))


def divide_shading(image: DataFrame, rendered: DataFrame, floor: float = 0.08, clamp: float | None = None) -> DataFrame:
    """v over the image's rendered shading: 0 below the floor, or with the shading clamped from below."""
    both = image.join(rendered.select("image_id", "r", "c", F.col("v").alias("shade")), ["image_id", "r", "c"])
    if clamp is not None:
        value = F.col("v") / F.greatest(F.col("shade"), F.lit(clamp))
    else:
        value = F.when(F.col("shade") >= floor, F.col("v") / F.greatest(F.col("shade"), F.lit(floor))).otherwise(0.0)
    return both.select("image_id", "r", "c", value.alias("v"))


def high_pass_shading(image: DataFrame, rendered: DataFrame, clamp: float = 0.15, k: int = DEFAULT.contrast_kernel) -> DataFrame:
    """divide_shading with clamped shading, then local contrast: the smooth residue of the shading, common to all images, goes."""
    return local_contrast(divide_shading(image, rendered, clamp=clamp), k)


def checkerboard(a: DataFrame, b: DataFrame, squares: int = 8) -> DataFrame:
    """Squares of a and b by turns, for each image of both; where a has no value, b's is shown."""
    size = extent(b)
    both = b.select("image_id", "r", "c", F.col("v").alias("vb")).join(a.select("image_id", "r", "c", F.col("v").alias("va")), ["image_id", "r", "c"], "left").join(size, "image_id")
    sy, sx = F.greatest(F.lit(1), F.floor(F.col("height") / squares)), F.greatest(F.lit(1), F.floor(F.col("width") / squares))
    odd = (F.floor(F.col("r") / sy) + F.floor(F.col("c") / sx)) % 2 == 1
    return both.select("image_id", "r", "c", F.when(odd | F.coalesce(F.col("va") == 0, F.lit(True)), F.col("vb")).otherwise(F.col("va")).alias("v"))


def fill_mean(pixels: DataFrame) -> DataFrame:
    """No data replaced by the image's mean."""
    mean = pixels.groupBy("image_id").agg(F.avg("v").alias("mean"))
    return pixels.join(mean, "image_id").select("image_id", "r", "c", F.coalesce("v", "mean").alias("v"))


def no_data(value: Column, *marks: float) -> Column:
    """NULL for the marks, NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | value.isin(*marks)
    return F.when(~bad, value)
