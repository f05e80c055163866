"""Rasters, match sets and catalogues derived from the given tables, and the same derivations in SQL.

pixels      image_id, r, c, v             from embeddings: a row per vector, a column per component
matches     pair_id, match_id, xa, ya, xb, yb, conf   from lineitem: a pair per supplier
footprints  product_id, instrument, west, east, south, north, span   from customer
tiles       tile_id, west, south          from supplier: boxes of 3 x 3 degrees
triples     tile, kind                    from part
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, image_id: str = "src", shift: int = 0) -> DataFrame:
    """The raster of embeddings, its columns rolled by shift."""
    e = read(spark, sf_dir, "embeddings")
    flat = e.select(F.col("vec_id").cast("int").alias("r"), F.size("embedding").alias("w"), F.posexplode("embedding").alias("c", "v"))
    return flat.select(F.lit(image_id).alias("image_id"), "r", F.pmod(F.col("c") + shift, F.col("w")).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


PIXELS = "px AS (SELECT CAST(vec_id AS INT) AS r, CAST(i - 1 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    xa = F.lit(512.0) * F.pow(F.pmod(37 * F.col("l_partkey") + F.col("l_orderkey"), F.lit(1000)) / 1000.0, F.lit(2))
    ya = F.lit(512.0) * F.pow(F.pmod(53 * F.col("l_orderkey") + F.col("l_partkey"), F.lit(1000)) / 1000.0, F.lit(3))
    base = li.select(
        F.col("l_suppkey").alias("pair_id"), (F.row_number().over(order) - 1).cast("long").alias("match_id"), xa.alias("xa"), ya.alias("ya"),
        "l_discount", "l_tax", "l_linenumber", "l_quantity",
    )
    out = (F.col("l_linenumber") == 7).cast("double")
    return base.select(
        "pair_id", "match_id", "xa", "ya",
        (1.02 * F.col("xa") - 0.03 * F.col("ya") + 21.5 + 20 * (F.col("l_discount") - 0.05) + out * (60 + F.col("xa") / 8)).alias("xb"),
        (0.03 * F.col("xa") + 1.02 * F.col("ya") - 4.25 + 20 * (F.col("l_tax") - 0.04) - 35 * out).alias("yb"),
        (F.col("l_quantity") / 50).alias("conf"),
    )


MATCHES = """m0 AS (
  SELECT l_suppkey AS pair_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS match_id,
    512.0::DOUBLE * pow(((37 * l_partkey + l_orderkey) % 1000) / 1000.0::DOUBLE, 2) AS xa, 512.0::DOUBLE * pow(((53 * l_orderkey + l_partkey) % 1000) / 1000.0::DOUBLE, 3) AS ya,
    l_discount, l_tax, l_quantity, CASE WHEN l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o
  FROM lineitem),
m AS (
  SELECT pair_id, match_id, xa, ya, 1.02::DOUBLE * xa - 0.03::DOUBLE * ya + 21.5::DOUBLE + 20 * (l_discount - 0.05::DOUBLE) + o * (60 + xa / 8) AS xb,
    0.03::DOUBLE * xa + 1.02::DOUBLE * ya - 4.25::DOUBLE + 20 * (l_tax - 0.04::DOUBLE) - 35 * o AS yb, l_quantity / 50 AS conf
  FROM m0)"""


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    west = F.pmod(F.col("c_custkey") * 37, F.lit(600)) / 10.0
    south = F.pmod(F.col("c_custkey") * 53, F.lit(600)) / 10.0 - 30
    return c.select(
        F.col("c_custkey").alias("product_id"), F.col("c_mktsegment").alias("instrument"), west.alias("west"),
        (west + 1 + F.col("c_nationkey") / 10.0).alias("east"), south.alias("south"), (south + 1 + F.pmod("c_custkey", F.lit(7))).alias("north"),
    )


FOOTPRINTS = """fp AS (
  SELECT c_custkey AS product_id, c_mktsegment AS instrument, ((c_custkey * 37) % 600) / 10.0::DOUBLE AS west,
    ((c_custkey * 37) % 600) / 10.0::DOUBLE + 1 + c_nationkey / 10.0::DOUBLE AS east, ((c_custkey * 53) % 600) / 10.0::DOUBLE - 30 AS south,
    ((c_custkey * 53) % 600) / 10.0::DOUBLE - 30 + 1 + (c_custkey % 7) AS north
  FROM customer)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    west = (3 * F.pmod(F.col("s_suppkey") * 7, F.lit(20))).cast("double")
    south = (3 * F.pmod(F.col("s_suppkey") * 11, F.lit(20)) - 30).cast("double")
    return s.select(F.col("s_suppkey").alias("tile_id"), west.alias("west"), (west + 3).alias("east"), south.alias("south"), (south + 3).alias("north"))


TILES = """tl AS (
  SELECT s_suppkey AS tile_id, CAST(3 * ((s_suppkey * 7) % 20) AS DOUBLE) AS west, CAST(3 * ((s_suppkey * 7) % 20) + 3 AS DOUBLE) AS east,
    CAST(3 * ((s_suppkey * 11) % 20) - 30 AS DOUBLE) AS south, CAST(3 * ((s_suppkey * 11) % 20) - 27 AS DOUBLE) AS north
  FROM supplier)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of tiles by kind: 0 morning, 1 evening, 2 elevation."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = F.pmod(k * k + F.floor(k / 5), F.lit(3))
    return p.select(F.floor(k / 4).alias("tile"), kind.cast("int").alias("kind"), F.col("p_size").alias("kbytes"), F.col("p_name").alias("path"))


TRIPLES = "tr AS (SELECT p_partkey // 4 AS tile, CAST((p_partkey * p_partkey + p_partkey // 5) % 3 AS INT) AS kind, p_size AS kbytes, p_name AS path FROM part)"
