"""Sinks: registered rasters, match points, metrics and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of the match-point file.
POINT_COLUMNS = {"xa": "source_x", "ya": "source_y", "xb": "reference_x", "yb": "reference_y", "conf": "confidence", "residual": "residual_px"}


def write_raster(pixels: DataFrame, path: str, tile: int = 256) -> None:
    """Parquet partitioned by image, rows of a tile together."""
    cells = pixels.withColumn("_t", F.floor(F.col("r") / tile)).repartition("image_id", "_t").sortWithinPartitions("image_id", "_t", "r", "c").drop("_t")
    cells.write.mode("overwrite").partitionBy("image_id").parquet(path)


def match_points(fitted: DataFrame, decimals: int = 4) -> DataFrame:
    """The match-point rows: four decimals (three in older files), inlier as 0 or 1."""
    return fitted.select("pair_id", *(F.format_string(f"%.{decimals}f", F.col(c)).alias(n) for c, n in POINT_COLUMNS.items()), F.col("inlier").cast("int").alias("inlier"))


def write_match_points(fitted: DataFrame, path: str, decimals: int = 4) -> None:
    match_points(fitted, decimals).write.mode("overwrite").partitionBy("pair_id").csv(path, header=True)


def metrics_json(metrics: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """pair_id, json of the metric block; unknown figures are absent, extra entries are merged in."""
    columns = [c for c in metrics.columns if c != "pair_id"]
    return metrics.select("pair_id", F.to_json(F.struct(*columns, *(F.lit(v).alias(k) for k, v in (extra or {}).items()))).alias("json"))


def write_metrics(metrics: DataFrame, path: str, extra: dict[str, str] | None = None) -> None:
    metrics_json(metrics, extra).write.mode("overwrite").partitionBy("pair_id").text(path)


def training_manifest(pairs: DataFrame, least: int = 64) -> DataFrame:
    """Training pairs(name, tile, tilt_deg, bx, by rows) with enough correspondences: name, tile, tilt_deg, n_correspondences."""
    return pairs.groupBy("name", "tile", "tilt_deg").agg(F.count("*").alias("n_correspondences")).where(F.col("n_correspondences") >= least)


def write_training_pairs(pairs: DataFrame, path: str, least: int = 64) -> None:
    """pairs/ with the correspondences of pairs that have enough, and manifest/ with a JSON line for each of them."""
    manifest = training_manifest(pairs, least)
    kept = pairs.join(manifest.select("name", "tile", "tilt_deg"), ["name", "tile", "tilt_deg"], "left_semi")
    kept.write.mode("overwrite").parquet(f"{path}/pairs")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def even_sample(matches: DataFrame, most: int = 120) -> DataFrame:
    """At most `most` matches of each pair, evenly spaced by match_id; for drawing."""
    w = Window.partitionBy("pair_id").orderBy("match_id")
    n = F.count("*").over(Window.partitionBy("pair_id"))
    numbered = matches.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    step = F.floor(F.col("_i") * most / F.col("_n")) != F.floor((F.col("_i") - 1) * most / F.col("_n"))
    return numbered.where((F.col("_n") <= most) | step).drop("_i", "_n")
