"""Queries of scale-space features and simulated views. Extrema and views have SQL; descriptors are tested against arrays and planted transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.fixtures import PIXELS, pixels
from regolith.operators import blocks, features
from regolith.plans import cases
from regolith.plans.match_queries import rounded
from regolith.plans.registration_queries import windows
from regolith.plans.training_queries import _skew_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: About the width of the raster's values.
SPAN = 0.25


def query(f):
    QUERIES[f.__name__] = f
    return f


def _octave_sql(octave: int, source: str) -> str:
    """Differences d{octave} and extrema e{octave} of a table source(r, c, v) that is a full rectangle."""
    kernels = ", ".join(f"({s}, {i - len(w) // 2}, {k!r}::DOUBLE)" for s, dev in enumerate(features.deviations(octave)) for w in [features.taps(dev).tolist()] for i, k in enumerate(w))
    o, n = octave, 2 * features.BORDER + 1
    least = features.CONTRAST * SPAN / features.SCALES / 2
    three = "BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    wide = f"BETWEEN {features.BORDER} PRECEDING AND {features.BORDER} FOLLOWING"

    def over(inner: str, by: str, along: str) -> str:
        frame = f"OVER (PARTITION BY {by} ORDER BY {along} RANGE {three})"
        return f"SELECT s, r, c, x, max(hi) {frame} AS hi, min(lo) {frame} AS lo FROM ({inner})"

    near = over(over(over(f"SELECT s, r, c, x, x AS hi, x AS lo FROM d{o}", "s, r", "c"), "s, c", "r"), "r, c", "s")
    return f"""kn{o}(s, d, k) AS (VALUES {kernels}),
h{o} AS (SELECT s, r, c + d AS c, sum(k * v) AS a, sum(k) AS b FROM {source}, kn{o} WHERE c + d BETWEEN 0 AND (SELECT max(c) FROM {source}) GROUP BY 1, 2, 3),
g{o} AS (SELECT h.s, r + d AS r, c, sum(k * a) / sum(k * b) AS v FROM h{o} h JOIN kn{o} n ON n.s = h.s WHERE r + d BETWEEN 0 AND (SELECT max(r) FROM {source}) GROUP BY 1, 2, 3),
d{o} AS (SELECT a.s, a.r, a.c, b.v - a.v AS x FROM g{o} a JOIN g{o} b ON b.s = a.s + 1 AND b.r = a.r AND b.c = a.c),
w{o} AS (SELECT r, c, count(*) OVER (PARTITION BY r ORDER BY c RANGE {wide}) AS n FROM {source}),
i{o} AS (SELECT r, c FROM (SELECT r, c, sum(n) OVER (PARTITION BY c ORDER BY r RANGE {wide}) AS n FROM w{o}) WHERE n = {n * n}),
e{o} AS (SELECT {o} AS octave, s AS level, r, c, x FROM ({near}) JOIN i{o} USING (r, c) WHERE s BETWEEN 1 AND {features.SCALES} AND ((x > {least!r} AND x >= hi) OR (x < -{least!r} AND x <= lo)))"""


@query
def scale_space_extrema(spark, sf_dir) -> DataFrame:
    """Extrema of the differences of blurs over two octaves of the whole raster."""
    levels = features.pyramid(blocks.to_blocks(pixels(spark, sf_dir)), 2)
    found = features.keypoints(levels, SPAN, settled=False)
    return found.select("octave", "level", F.col("ri").alias("r"), F.col("ci").alias("c"), F.round("response", 9).alias("v"))


SQL["scale_space_extrema"] = f"""WITH {PIXELS}, {_octave_sql(0, 'px')}, o1 AS (SELECT r // 2 AS r, c // 2 AS c, v FROM g0 WHERE s = {features.SCALES} AND r % 2 = 0 AND c % 2 = 0), {_octave_sql(1, 'o1')}
SELECT CAST(octave AS INT) AS octave, CAST(level AS INT) AS level, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(x, 9) AS v FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1)"""


@query
def scale_space_features(spark, sf_dir) -> DataFrame:
    """Places, sizes and angles of the whole raster's features, and the sums of their descriptors."""
    found = features.of_blocks(blocks.to_blocks(pixels(spark, sf_dir)), SPAN, octaves=3)
    return rounded(found.select("feature_id", "y", "x", "size", "angle", "response", F.aggregate("d", F.lit(0.0), lambda a, x: a + x).alias("d_sum")), 4)


VIEWS = ((1, math.sqrt(2), 72 / math.sqrt(2)), (2, 2.0, 36.0))


@query
def view_rasters(spark, sf_dir) -> DataFrame:
    """Two simulated views of the whole raster as one block raster: their cells that show something of it."""
    tiled = blocks.to_blocks(pixels(spark, sf_dir))
    sizes = tiled.groupBy("image_id").agg(F.max(F.col("r0") + F.col("h")).alias("h"), F.max(F.col("c0") + F.col("w")).alias("w"))
    cells = blocks.to_cells(features.view_blocks(tiled, features.placed_views(sizes, list(VIEWS)), 0.0))
    return cells.select(F.substring_index("image_id", ":", 1).cast("int").alias("view"), "r", "c", F.round("v", 6).alias("v")).where("v <> 0")


SQL["view_rasters"] = " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS view, * FROM ({_skew_sql(t, p)}) WHERE v <> 0" for k, t, p in VIEWS)


@query
def feature_matches(spark, sf_dir) -> DataFrame:
    """Matches of each window with its copy rolled by 3 columns, by scale-space features."""
    return rounded(cases.by_features(cases.DEFAULT)(windows(spark, sf_dir), windows(spark, sf_dir, 3)), 4)


@query
def tilted_feature_matches(spark, sf_dir) -> DataFrame:
    """The same over 18 simulated views of both."""
    return rounded(cases.by_tilted_features(cases.DEFAULT)(windows(spark, sf_dir), windows(spark, sf_dir, 3)), 4)
