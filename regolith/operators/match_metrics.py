"""Metrics of match sets. A match set is a relation keyed by pair_id and match_id, so nothing is aligned by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regolith.config import DEFAULT, Config
from regolith.functions.tables import written
from regolith.operators.raster import quantiles


def cell(size: float, grid: int, x: str = "xa", y: str = "ya") -> tuple[Column, Column]:
    """Grid row and column of a point: truncated, then clipped into the grid."""
    of = lambda v: F.greatest(F.lit(0), F.least(F.lit(grid - 1), (F.col(v) / size * grid).cast("int")))
    return of(y), of(x)


def uniformity(matches: DataFrame, size: float, grid: int = DEFAULT.uniformity_grid, pairs: DataFrame | None = None) -> DataFrame:
    """pair_id, coverage (share of cells hit) and entropy (normalised by the log of the cells).

    With pairs(pair_id) there is a row for each of them, (0, 0) for those without matches; else these are absent.
    """
    gy, gx = cell(size, grid)
    counts = matches.groupBy("pair_id", (gy * grid + gx).alias("cell")).agg(F.count("*").alias("n"))
    # sum(-p ln p) = ln N - sum(n ln n) / N, from one pass over the cell counts
    sums = counts.groupBy("pair_id").agg(F.count("*").alias("cells"), F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    entropy = (F.ln("total") - F.col("nln") / F.col("total")) / F.ln(F.lit(float(grid * grid)))
    found = sums.select("pair_id", (F.col("cells") / float(grid * grid)).alias("coverage"), entropy.alias("entropy"))
    return found if pairs is None else pairs.select("pair_id").distinct().join(found, "pair_id", "left").fillna(0.0, ["coverage", "entropy"])


def coverage_grid(matches: DataFrame, size: float, grid: int = DEFAULT.uniformity_grid) -> DataFrame:
    """pair_id, gy, gx, n for every cell of the grid, empty ones included."""
    gy, gx = cell(size, grid)
    counts = matches.groupBy("pair_id", gy.alias("gy"), gx.alias("gx")).agg(F.count("*").alias("n"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("k")
    every = matches.select("pair_id").distinct().select("pair_id", cells)
    every = every.select("pair_id", F.floor(F.col("k") / grid).cast("int").alias("gy"), (F.col("k") % grid).cast("int").alias("gx"))
    return every.join(counts, ["pair_id", "gy", "gx"], "left").select("pair_id", "gy", "gx", F.coalesce("n", F.lit(0)).alias("n"))


def _medians(offsets: DataFrame, by: tuple[str, ...], **columns: Column) -> DataFrame:
    """by... and the exact median of each column, by a sort over ranges: no task sees a pair as a whole."""
    axes = F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), v.cast("double").alias("x")) for k, v in columns.items()))).alias("s")
    found = quantiles(offsets.select(*by, axes).select(*by, "s.axis", "s.x"), (*by, "axis"), (0.5,))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("axis") == k, F.element_at("p", 1))).alias(k) for k in columns))


def offset_mad(matches: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Median translation and its median absolute deviations; NULL below min_matches, as is the count's row kept."""
    off = matches.select(*by, (F.col("xb") - F.col("xa")).alias("ox"), (F.col("yb") - F.col("ya")).alias("oy"))
    counts = off.groupBy(*by).agg(F.count("*").alias("n"))
    off = off.join(counts.where(F.col("n") >= cfg.min_matches).select(*by), list(by), "left_semi")
    med = written(_medians(off, by, dx=F.col("ox"), dy=F.col("oy")), "medians")
    mad = _medians(off.join(med, list(by)), by, mad_x=F.abs(F.col("ox") - F.col("dx")), mad_y=F.abs(F.col("oy") - F.col("dy")))
    return counts.join(med.join(mad, list(by), "left"), list(by), "left").select(*by, "n", "dx", "dy", "mad_x", "mad_y")


def coarse_offset(matches: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Median translation rounded half to even; (0, 0, n) below min_matches."""
    counts = matches.groupBy("pair_id").agg(F.count("*").alias("n"))
    enough = matches.join(counts.where(F.col("n") >= cfg.min_matches).select("pair_id"), "pair_id", "left_semi")
    med = _medians(enough, ("pair_id",), x=F.col("xb") - F.col("xa"), y=F.col("yb") - F.col("ya"))
    of = lambda c: F.coalesce(F.rint(c), F.lit(0.0)).cast("int")
    return counts.join(med, "pair_id", "left").select("pair_id", of("x").alias("dx"), of("y").alias("dy"), "n")


def cross_window_spread(offsets: DataFrame) -> DataFrame:
    """hypot of the population deviations of dx and dy over a pair's windows; NULL below two."""
    spread = F.hypot(F.stddev_pop("dx"), F.stddev_pop("dy"))
    return offsets.where(F.col("dx").isNotNull()).groupBy("pair_id").agg(F.when(F.count("*") >= 2, spread).alias("spread"), F.count("*").alias("windows"))


def apply_model(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """Point mapped by a row-major 3 x 3 model; affine models have the last row 0, 0, 1."""
    at = lambda i: F.element_at(m, i)
    w = at(7) * x + at(8) * y + at(9)
    return (at(1) * x + at(2) * y + at(3)) / w, (at(4) * x + at(5) * y + at(6)) / w


def residuals(matches: DataFrame, models: DataFrame) -> DataFrame:
    """matches with residual, the distance between the mapped and the matched point; models(pair_id, m)."""
    px, py = apply_model(F.col("xa"), F.col("ya"), F.col("m"))
    joined = matches.join(models.select("pair_id", "m"), "pair_id")
    return joined.withColumn("residual", F.hypot(px - F.col("xb"), py - F.col("yb"))).drop("m")


def summarise(fitted: DataFrame, size: float, dof: int | str = 4, gsd_m: float | None = None, source_gsd_m: float | None = None, grid: int = DEFAULT.uniformity_grid) -> DataFrame:
    """The metric block of each pair, from matches with residual and inlier.

    rmse_px is over inliers as they are; rmse_px_guarded is NULL unless they over-determine the model, and
    sub_pixel follows the guarded figure. dof is the model's degrees of freedom, or the column of fitted that has them. Figures that need an unknown GSD are NULL, and so absent in JSON.
    """
    inl = F.col("inlier")
    base = fitted.groupBy("pair_id").agg(
        (F.max(dof) if isinstance(dof, str) else F.lit(dof)).alias("dof"), F.count("*").alias("match_count"), F.count_if(inl).alias("inlier_count"), F.sqrt(F.avg(F.when(inl, F.col("residual") * F.col("residual")))).alias("rmse_px")
    )
    ok = 2 * F.col("inlier_count") > F.col("dof")
    base = base.withColumn("inlier_ratio", F.col("inlier_count") / F.col("match_count")).withColumn("rmse_px_guarded", F.when(ok, F.col("rmse_px"))).drop("dof")
    base = base.withColumn("sub_pixel", F.coalesce(F.col("rmse_px_guarded") < 1.0, F.lit(False)))
    gsd, own = F.lit(gsd_m).cast("double"), F.lit(source_gsd_m).cast("double")
    base = base.withColumn("rmse_m", F.col("rmse_px") * gsd).withColumn("rmse_source_px", F.col("rmse_px") * gsd / own)
    base = base.withColumn("sub_pixel_source", F.when(own.isNotNull() & gsd.isNotNull(), F.coalesce(F.col("rmse_source_px") < 1.0, F.lit(False))))
    spread = uniformity(fitted.where(inl), size, grid)
    return base.join(spread, "pair_id", "left").fillna(0.0, ["coverage", "entropy"])


def identity_score(matches: DataFrame) -> DataFrame:
    """Counts within 1, 3 and 5 px of the identity, and the RMSE of those within 3."""
    d = F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
    return matches.withColumn("d", d).groupBy("pair_id").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("d") <= t).alias(f"within_{t}") for t in (1, 3, 5)), F.sqrt(F.avg(F.when(F.col("d") <= 3, F.col("d") * F.col("d")))).alias("rmse_3")
    )


def bucket_top_k(matches: DataFrame, size: float, per_cell: int | None = None, grid: int = DEFAULT.uniformity_grid) -> DataFrame:
    """The most confident matches of each cell; per_cell None: max(1, matches of the pair div cells)."""
    gy, gx = cell(size, grid)
    placed = matches.withColumn("cell", gy * grid + gx)
    rank = F.row_number().over(Window.partitionBy("pair_id", "cell").orderBy(F.desc("conf"), "match_id"))
    placed = placed.withColumn("rank", rank)
    if per_cell is not None:
        return placed.where(F.col("rank") <= per_cell)
    share = matches.groupBy("pair_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / (grid * grid))).alias("k"))
    return placed.join(share, "pair_id").where(F.col("rank") <= F.col("k")).drop("k")


def dedupe_first(matches: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """The first match of each pair of rounded positions in both images (half to even)."""
    key = [F.rint(F.col(c) / tolerance) for c in ("xa", "ya", "xb", "yb")]
    return matches.withColumn("k", F.row_number().over(Window.partitionBy("pair_id", *key).orderBy("match_id"))).where("k = 1").drop("k")


def decompose(models: DataFrame) -> DataFrame:
    """Scale along x and y, rotation (degrees), shear and anisotropy of the linear part of m."""
    a, b, c, d = (F.element_at("m", i) for i in (1, 2, 4, 5))
    sx = F.hypot(a, c)
    return models.select(
        "pair_id", sx.alias("scale_x"), ((a * d - b * c) / sx).alias("scale_y"), F.degrees(F.atan2(c, a)).alias("rotation_deg"),
        ((a * b + c * d) / (sx * sx)).alias("shear"), (sx / F.abs((a * d - b * c) / sx)).alias("anisotropy"),
    )


def axis_significance(chunks: DataFrame) -> DataFrame:
    """Over chunks(scale_x, scale_y, dy, row0): means, how many standard errors each is from 1, and the drift of dy."""
    sigma = lambda c: F.abs(F.avg(c) - 1) / (F.stddev_samp(c) / F.sqrt(F.count(c)))
    return chunks.agg(
        F.count("*").alias("chunks"), F.avg("scale_x").alias("mean_x"), sigma("scale_x").alias("sigma_x"), F.avg("scale_y").alias("mean_y"), sigma("scale_y").alias("sigma_y"),
        F.regr_slope("dy", "row0").alias("drift"),
    ).withColumn("verdict", F.when((F.col("sigma_x") > 3) & (F.col("sigma_y") > 3), "both axes").when(F.col("sigma_x") > 3, "cross track").when(F.col("sigma_y") > 3, "along track").otherwise("neither"))
