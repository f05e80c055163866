"""Sources: rasters, strips with geolocation, labels and catalogues as DataFrames.

Image codecs are not bundled: rasters come as Parquet cells (image_id, r, c, v), best written by
write_raster, which keeps the cells of a tile together so that a window read skips row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOLOC = "Longitude double, Latitude double, Pixel double, Scan double"


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of some Parquet sources that is there, as the full data or else a sample of it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {paths} is there")


def read_window(spark: SparkSession, path: str, image_id: str, row: int, col: int, height: int, width: int) -> DataFrame:
    """Cells of a window; the bounds reach the Parquet scan."""
    cells = spark.read.parquet(path).where((F.col("image_id") == image_id) & F.col("r").between(row, row + height - 1) & F.col("c").between(col, col + width - 1))
    return cells.select("image_id", (F.col("r") - row).alias("r"), (F.col("c") - col).alias("c"), "v")


def read_geolocation(spark: SparkSession, path: str) -> DataFrame:
    """Geolocation samples of a strip from CSV: lon, lat, pixel, scan."""
    return spark.read.csv(path, header=True, schema=GEOLOC).toDF("lon", "lat", "pixel", "scan")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Whole label files: file, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """Footprint records with the file they came from as _file."""
    return spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_name"))


def sample_cases(spark: SparkSession, path: str) -> DataFrame:
    """case, attributes of a JSON index whose top-level objects are the cases (other values are notes)."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,string>")).alias("case", "json")
    return whole.select(pairs).where(F.ltrim("json").startswith("{")).select("case", F.from_json("json", "map<string,string>").alias("attributes"))


def archive_path(archive: str, inner: str) -> str:
    """Path of a member inside an archive."""
    return f"/vsizip/{archive}/{inner}"


def first_member(members: DataFrame, suffix: str, prefix: str = "", preferred: str = "") -> DataFrame:
    """archive, name: the first member of each archive by position with the suffix and prefix; one that holds the preferred text goes before all others."""
    fit = members.where(F.col("name").endswith(suffix) & F.col("name").startswith(prefix))
    return fit.groupBy("archive").agg(F.min_by("name", F.struct(~F.col("name").contains(preferred), "position")).alias("name"))


def pair_violations(ortho: DataFrame, dtm: DataFrame) -> DataFrame:
    """Ids whose terrain model is not exactly half the ortho's size with the same bounds, or is not there."""
    d = dtm.select(F.regexp_replace("id", "_dtm_", "_oth_").alias("id"), *(F.col(c).alias(f"d_{c}") for c in ("width", "height", "west", "south")))
    both = ortho.join(d, "id", "left")
    ok = (F.col("width") == 2 * F.col("d_width")) & (F.col("height") == 2 * F.col("d_height")) & (F.abs(F.col("west") - F.col("d_west")) < 1e-6) & (F.abs(F.col("south") - F.col("d_south")) < 1e-6)
    return both.where(~F.coalesce(ok, F.lit(False))).select("id")
