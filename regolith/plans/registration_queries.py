"""Registration and gate queries over windows of bounded size, and swaths on one grid. What rests on numeric kernels has no SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.config import Config
from regolith.fixtures import PIXELS, pixels
from regolith.functions.tables import written
from regolith.operators import matching, raster
from regolith.plans import bands, cases, registration
from regolith.plans import raster_queries as rq
from regolith.plans.match_queries import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Rows of a window; the raster is cut into windows of this height, so that no group grows with it.
WINDOW = 128
CONFIG = Config(contrast_kernel=15, refine_patch=16)


def query(f):
    QUERIES[f.__name__] = f
    return f


def windows(spark, sf_dir, shift: int = 0) -> DataFrame:
    """Windows of the raster as images. Every row is in one; the last window reaches back over rows of the one before."""
    p = pixels(spark, sf_dir, "w", shift)
    rows = p.agg(F.max("r") + 1).first()[0] or 0
    full, last = rows // WINDOW, max(rows - WINDOW, 0)
    own = F.floor(F.col("r") / WINDOW).cast("int")
    of = F.array(F.when(own < full, own), F.when((F.col("r") >= last) & F.lit(rows > full * WINDOW), F.lit(full)))
    placed = p.withColumn("k", F.explode(F.filter(of, lambda k: k.isNotNull())))
    first = F.when(F.col("k") < full, F.col("k") * WINDOW).otherwise(F.lit(last))
    return placed.select(F.concat(F.lit("w"), F.col("k").cast("string")).alias("image_id"), (F.col("r") - first).cast("int").alias("r"), "c", "v")


@query
def phase_shift(spark, sf_dir):
    """Offset and response of each window against its copy rolled by 3 columns."""
    both = windows(spark, sf_dir).select("image_id", "r", "c", F.col("v").alias("a")).join(windows(spark, sf_dir, 3).select("image_id", "r", "c", F.col("v").alias("b")), ["image_id", "r", "c"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((2, pdf["r"].max() + 1, pdf["c"].max() + 1))
        g[0, pdf["r"], pdf["c"]], g[1, pdf["r"], pdf["c"]] = pdf["a"], pdf["b"]
        return pd.DataFrame([(pdf["image_id"].iloc[0], *matching.phase_shift(*g))], columns=["image_id", "dx", "dy", "response"])

    return rounded(both.groupBy("image_id").applyInPandas(one, "image_id string, dx double, dy double, response double"), 3)


@query
def match_windows(spark, sf_dir):
    return rounded(registration.default_match(cfg=CONFIG)(windows(spark, sf_dir), windows(spark, sf_dir, 3)), 4)


@query
def refine_matches(spark, sf_dir):
    a, b = (raster.local_contrast(windows(spark, sf_dir, s), 15).select("image_id", "r", "c", "u") for s in (0, 3))
    found = written(matching.match_tiles(a, b, cfg=CONFIG), "matches")
    return rounded(matching.refine(found, a, b, CONFIG).select("pair_id", "match_id", "xa", "ya", "xb", "yb"), 3)


@query
def register_pair(spark, sf_dir):
    r = registration.register(windows(spark, sf_dir), windows(spark, sf_dir, 3), 64.0, 7.403, 7.403, 5.05, registration.default_match(cfg=CONFIG), cfg=CONFIG)
    return rounded(r.metrics, 4)


@query
def control_gate(spark, sf_dir):
    return registration.control_gate(windows(spark, sf_dir), windows(spark, sf_dir, 3), registration.default_match(cfg=CONFIG), CONFIG)


@query
def case_scores(spark, sf_dir):
    """Two methods over every window as a case, each gated."""
    methods = {name: cases.METHODS[name](CONFIG) for name in ("contrast", "stretch")}
    return rounded(cases.run(windows(spark, sf_dir), windows(spark, sf_dir, 3), 64.0, methods, cfg=CONFIG), 4)


#: The second swath's samples lie this far from the first one's, in steps of its columns and rows.
COLUMNS, ROWS = 5, 9


def swaths(spark, sf_dir):
    """The strip as two swaths: the second has the first's ground from another column and row on, another value where it has no data."""
    geo = rq.geoloc(spark, sf_dir).select("image_id", "r", "c", "lon", "lat")
    p = pixels(spark, sf_dir)
    second = p.select(F.lit("b").alias("image_id"), F.lit(2).alias("band"), (F.col("r") - ROWS).alias("r"), (F.col("c") - COLUMNS).alias("c"), F.when((F.col("r") + F.col("c")) % 11 == 0, bands.IGNORE).otherwise(F.col("v")).alias("v"))
    there = (F.col("r") >= 0) & (F.col("c") >= 0)
    table = spark.createDataFrame([("src", 1, 1504.0), ("b", 1, 700.0), ("b", 2, 1510.0)], "image_id string, band int, wavelength_nm double")
    moved = geo.select(F.lit("b").alias("image_id"), (F.col("r") - ROWS).alias("r"), (F.col("c") - COLUMNS).alias("c"), "lon", "lat")
    a = bands.Swath(p.withColumn("band", F.lit(1)), table.where("image_id = 'src'"), geo)
    return a, bands.Swath(second.where(there), table.where("image_id = 'b'"), moved.where(there), bands.IGNORE)


GROUND = f"""WITH {PIXELS}, {rq.GEOLOC}, g AS (SELECT 'a' AS k, r, c, lon, lat FROM gl UNION ALL SELECT 'b', r, c, lon, lat FROM gl WHERE r >= {ROWS} AND c >= {COLUMNS}), e AS (SELECT k, r, min(c) AS c0, max(c) AS c1 FROM g GROUP BY ALL),
d AS (SELECT e.k, avg({rq.ARC} / (c1 - c0)) AS gsd FROM e JOIN g a ON a.k = e.k AND a.r = e.r AND a.c = c0 JOIN g b ON b.k = e.k AND b.r = e.r AND b.c = c1 GROUP BY e.k),
x AS (SELECT k, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM g GROUP BY k)
SELECT round(max(w), 6) AS west, round(max(s), 6) AS south, round(min(e), 6) AS east, round(min(n), 6) AS north, round(max(gsd) FILTER (k = 'a'), 6) AS gsd_a, round(max(gsd) FILTER (k = 'b'), 6) AS gsd_b, true AS shares FROM x JOIN d USING (k)"""


@query
def shared_ground(spark, sf_dir):
    a, b = swaths(spark, sf_dir)
    return rounded(bands.shared_ground(a.geoloc, b.geoloc))


SQL["shared_ground"] = GROUND


@query
def swath_overlap(spark, sf_dir):
    """The second swath's band on the first one's samples: no data where its mark or its edge is."""
    a, b = swaths(spark, sf_dir)
    one = bands.tagged_bands(b, (1504.0,), (False,), True)
    return bands.on_grid(one, b.geoloc, a.geoloc.select("r", "c", "lon", "lat"), b.ignore, 1)


SQL["swath_overlap"] = f"""WITH {PIXELS}, x AS (SELECT r, c, v, r >= {ROWS} AND c >= {COLUMNS} AND (r + c) % 11 <> 0 AS valid FROM px)
SELECT '1504:false' AS image_id, r, c, CASE WHEN valid THEN v ELSE 0 END AS v, valid FROM x"""


@query
def swath_neighbours(spark, sf_dir):
    """For each sample of the first swath the second one's within 0.75 pixels on the ground."""
    a, b = swaths(spark, sf_dir)
    key = (F.col("r").cast("long") * 64 + F.col("c"))
    points = a.geoloc.select(key.alias("id"), "lon", "lat")
    return rounded(bands.nearest_on_ground(points, b.geoloc.select(key.alias("sid"), "lon", "lat"), 75.0, 12.0).select("id", "sid", "d"))


SQL["swath_neighbours"] = f"WITH {PIXELS} SELECT CAST(r * 64 + c AS BIGINT) AS id, CAST((r - {ROWS}) * 64 + c - {COLUMNS} AS BIGINT) AS sid, 0::DOUBLE AS d FROM px WHERE r >= {ROWS} AND c >= {COLUMNS}"
