"""Product catalogues: pages of JSON answers to tables, kept as snapshots that are searched by box and read page by page.

A snapshot is Parquet in the order of grid cells, with the box of each product as plain columns: comparisons with
west, east, south and north reach the scan, which passes over files and row groups of other places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.documents import json_objects

#: Names of an answer's fields.
FIELDS = {"product_id": "pdsid", "kind": "pt", "west": "Westernmost_longitude", "east": "Easternmost_longitude", "south": "Minimum_latitude", "north": "Maximum_latitude"}
#: Degrees of the cells in whose order a snapshot is written.
CELL = 6.0


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """page, text of whole JSON answers, a file each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.col("value").alias("text"))


def products(answers: DataFrame) -> DataFrame:
    """page, product_id, kind, west, east, south, north, body of the products of answers(page, text), one or many in each.

    Numbers that do not parse are NULL. An answer that is an error, or no JSON, makes the query fail and names its
    page: a search without it would be short. Empty and null answers hold no products.
    """
    status, message = (F.get_json_object("text", f"$.ODEResults.{k}") for k in ("Status", "Error"))
    failed = F.when(status == "ERROR", F.concat_ws(": ", "page", F.coalesce(message, F.lit("error"))))
    checked = answers.select("page", F.coalesce(F.when(failed.isNotNull(), F.raise_error(failed).cast("string")), F.col("text")).alias("text"))
    found = json_objects(checked, "text", FIELDS["product_id"])
    broken = F.raise_error(F.concat_ws(": ", "page", "error")).cast("string")
    field = lambda name: F.get_json_object("body", f"$.{FIELDS[name]}")
    rows = found.select("page", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("body")).alias("body"))
    return rows.select("page", *(field(k).alias(k) for k in ("product_id", "kind")), *(field(k).try_cast("double").alias(k) for k in ("west", "east", "south", "north")), "body")


def snapshot(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The snapshot at path, made and written where there is none, or where it is forced; one cut off while written is made again."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if force or not there:
        table = make()
        x, y = ((F.col(a) + F.col(b)) / 2 / CELL for a, b in (("west", "east"), ("south", "north")))
        ordered = table.withColumn("_y", F.floor(y)).withColumn("_x", F.floor(x)).repartitionByRange("_y", "_x").sortWithinPartitions("_y", "_x", "product_id").drop("_x", "_y")
        ordered.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def within(catalogue: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Products whose boxes touch a box; longitudes from 0 to 360, and west > east is a box across the meridian."""
    lat = (F.col("south") <= north) & (F.col("north") >= south)
    before, after = F.col("west") <= east, F.col("east") >= west
    return catalogue.where(lat & ((before & after) if west <= east else (before | after)))


def page(catalogue: DataFrame, size: int, after: str | int | None = None) -> DataFrame:
    """The next products in the order of their ids behind the last one seen: a page costs the same wherever it lies."""
    rest = catalogue if after is None else catalogue.where(F.col("product_id") > F.lit(after))
    return rest.orderBy("product_id").limit(size)
