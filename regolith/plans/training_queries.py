"""Queries of training windows, training figures, product choice and simulated views, and their DuckDB equivalents."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from regolith.config import DEFAULT
from regolith.fixtures import FOOTPRINTS, MATCHES, PIXELS, SIZE, TILES, TRIPLES, footprints, matches, pixels, read, tiles, triples
from regolith.operators import catalog as ct
from regolith.operators import documents as dc
from regolith.operators import evaluation as ev
from regolith.operators import geometry as ge
from regolith.operators import photometry as ph
from regolith.operators import raster as ra
from regolith.operators import training as tr
from regolith.plans import match_queries as mq
from regolith.plans import raster_queries as rq
from regolith.plans.match_queries import rounded
from regolith.sources import rasters, sinks

QUERIES, SQL = {}, {}
WINDOW = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def placed(axis: str, side: str, step: float) -> str:
    return f"CAST(floor(((k * {step!r}::DOUBLE) % 1.0::DOUBLE) * ({side} - {WINDOW} + 1)) AS INT) AS {axis}"


@query(f"""SELECT p_partkey AS image_id, {placed('row', 'h', tr.STEPS[0])}, {placed('col', 'w', tr.STEPS[1])}
FROM (SELECT p_partkey, 10 + p_size AS h, 5 + 2 * p_size AS w FROM part), range(1, 5) t(k) WHERE h >= {WINDOW} AND w >= {WINDOW}""")
def window_places(spark, sf_dir):
    images = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (10 + F.col("p_size")).alias("height"), (5 + 2 * F.col("p_size")).alias("width"))
    return tr.drawn_places(images, 4, WINDOW)


PLACES = "pl AS (SELECT DISTINCT CAST((p_partkey * 37) % (h - 15) AS INT) AS row, CAST((p_partkey * 11) % 56 AS INT) AS col FROM part, (SELECT max(r) + 1 AS h FROM px))"


def places(spark, sf_dir):
    """A window for each part; those in the last columns run past the raster's edge."""
    height = pixels(spark, sf_dir).agg((F.max("r") + 1).alias("h"))
    at = read(spark, sf_dir, "part").join(F.broadcast(height))  # one row
    return at.select(F.lit("src").alias("image_id"), F.expr("cast((p_partkey * 37) % (h - 15) as int)").alias("row"), F.expr("cast((p_partkey * 11) % 56 as int)").alias("col"))


@query(f"""WITH {PIXELS}, {PLACES}, t AS (SELECT row, col, unnest([row // 16, row // 16 + 1]) AS br FROM pl), w AS (SELECT row, col, v * 100 + 10 AS v FROM t JOIN px ON r // 16 = br AND r BETWEEN row AND row + 15 AND c BETWEEN col AND col + 15),
g AS (SELECT row, col, count(*) AS n, stddev_pop(v) AS s, avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM w GROUP BY ALL)
SELECT row, col, round(s, 6) AS deviation, round(p, 6) AS padding FROM g WHERE n = 256 AND s >= 12 AND p <= 0.25""")
def training_windows(spark, sf_dir):
    """Windows of a raster of which about every fifth cell counts as padding; a blank one deviates by less than 12."""
    p = pixels(spark, sf_dir).withColumn("v", F.col("v") * 100 + 10)
    return rounded(tr.usable_windows(p, places(spark, sf_dir), WINDOW, 12.0, 0.25).drop("image_id"))


@query("""WITH s AS (SELECT s_suppkey AS image_id, 400 + s_nationkey * 10 AS h, 300 AS w, (s_suppkey % 5) / 10.0::DOUBLE AS slope, 100 + s_suppkey % 90 AS b FROM supplier),
t AS (SELECT *, floor((h - 96) * k / 3) AS top FROM s, range(4) k(k)), l AS (SELECT *, greatest(0, least(w - 96, floor(slope * (top + 48) + b - 48))) AS l FROM t)
SELECT image_id, CAST(top + dy AS INT) AS row, CAST(l + dx AS INT) AS col FROM l, (SELECT unnest([0, 32, 64]) AS dy), (SELECT unnest([0, 32, 64]) AS dx)""")
def swath_windows(spark, sf_dir):
    s = F.col("s_suppkey")
    strips = read(spark, sf_dir, "supplier").select(
        s.alias("image_id"), (400 + F.col("s_nationkey") * 10).alias("height"), F.lit(300).alias("width"), ((s % 5) / 10.0).alias("slope"), (100 + s % 90).alias("intercept")
    )
    return tr.swath_places(strips, 4, 96, 32)


@query(f"""WITH {TRIPLES}, n AS (SELECT kind, path, tile, dense_rank() OVER (PARTITION BY kind ORDER BY path) AS k FROM tr) SELECT kind, path AS name, tile AS image_id FROM n WHERE k > 2 AND tile % 7 <> 0""")
def safe_files(spark, sf_dir):
    """Files that may be trained on: neither among the first two names of a kind nor of a tile that an evaluation uses."""
    files = tr.after_first(triples(spark, sf_dir).select("kind", F.col("path").alias("name"), F.col("tile").alias("image_id")), "kind", 2)
    return tr.without_evaluation(files, files.where(F.col("image_id") % 7 == 0)).select("kind", "name", "image_id")


@query(f"""WITH {PIXELS}, k AS (SELECT r // 50 AS pair_id, r AS i, c AS j, v + 0.5::DOUBLE AS conf, c = (r * 7) % 64 OR c = (r * 13) % 64 AS t FROM px),
q AS (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, conf)) AS p FROM k), b AS (SELECT pair_id, i, arg_max(t, {{'a': conf, 'b': -j}}) AS hit FROM q GROUP BY ALL),
f AS (SELECT pair_id, count(*) FILTER (t) AS n, avg(-0.25::DOUBLE * pow(1 - p, 2) * ln(p)) FILTER (t) + avg(-0.75::DOUBLE * pow(p, 2) * ln(1 - p)) FILTER (NOT t) AS loss FROM q GROUP BY pair_id)
SELECT CAST(pair_id AS INT) AS pair_id, n AS true_cells, round((SELECT count(*) FILTER (hit) FROM b WHERE b.pair_id = f.pair_id) / n, 6) AS precision, round(loss, 6) AS loss FROM f""")
def coarse_figures(spark, sf_dir):
    """The raster as confidences of fifty source cells a pair, each with two true cells."""
    p = pixels(spark, sf_dir).select(F.floor(F.col("r") / 50).cast("int").alias("pair_id"), F.col("r").alias("i"), F.col("c").alias("j"), (F.col("v") + 0.5).alias("conf"))
    truth = p.select("pair_id", "i").distinct().select("pair_id", "i", F.explode(F.array(F.col("i") * 7 % 64, F.col("i") * 13 % 64)).alias("j"))
    return rounded(tr.coarse_figures(p, truth))


@query(f"WITH {MATCHES} SELECT pair_id, count(*) FILTER (conf >= 0.5) AS confident FROM m GROUP BY pair_id")
def confident_matches(spark, sf_dir):
    return tr.confident(matches(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS file, o_orderkey % 11 = 0 AS none, o_orderkey % 13 = 0 AS broken, o_custkey % 3 = 0 AS unsaved, o_custkey % 4 = 0 AS no_baseline, o_custkey % 5 = 0 AS no_guard FROM orders)
SELECT file, NOT none AS found, NOT none AND NOT broken AS readable, CASE WHEN NOT none AND NOT broken THEN unsaved END AS unsaved, CASE WHEN NOT none AND NOT broken THEN no_baseline END AS no_baseline,
  CASE WHEN NOT none AND NOT broken THEN no_guard END AS no_guard, NOT none AND NOT broken AND NOT unsaved AND NOT no_baseline AND NOT no_guard AS sound FROM o""")
def report_provenance(spark, sf_dir):
    """A report for each order: some are missing, some are cut short, some lack what a present run records."""
    o = read(spark, sf_dir, "orders")
    cust = F.col("o_custkey")
    saved = F.when(cust % 3 == 0, "false").when(cust % 2 == 0, "true").otherwise("null")
    baseline = F.when(cust % 4 == 0, "").otherwise(F.concat(F.lit(', "baseline_real_matches": '), F.when(cust % 7 == 0, "null").otherwise(cust.cast("string"))))
    history = F.when(cust % 5 == 0, "[]").otherwise('[{"real_matches": 12}, {}]')
    text = F.concat(F.lit('{"checkpoint_saved": '), saved, baseline, F.lit(', "history": '), history, F.when(F.col("o_orderkey") % 13 == 0, "").otherwise("}"))
    reports = o.where(F.col("o_orderkey") % 11 != 0).select(F.col("o_orderkey").alias("file"), text.alias("json"))
    return tr.provenance(o.select(F.col("o_orderkey").alias("file")), reports)


@query(f"WITH {TRIPLES} SELECT path, tile, kind, CASE kind WHEN 0 THEN 'N' || tile || 'E' WHEN 1 THEN 'S' || tile || 'W' END AS code FROM tr")
def tile_codes(spark, sf_dir):
    kind = F.col("kind")
    stem = F.when(kind == 0, "mor_").when(kind == 1, "EVE_").otherwise("dtm-")
    name = F.concat(stem, F.when(kind == 0, "n").otherwise("s"), F.col("tile").cast("string"), F.when(kind == 0, "e").otherwise("w"))
    return triples(spark, sf_dir).select("path", "tile", "kind", tr.tile_code(name, ("MOR_", "EVE_")).alias("code"))


BASELINE = f"""WITH {MATCHES}, sp AS (SELECT * FROM m WHERE pair_id % 10 <> 3 OR match_id < 5), {mq._ransac('affine', 'sp', '_b')}, n AS (SELECT pair_id, count(*) AS matches FROM sp GROUP BY pair_id),
f AS (SELECT pair_id, xa, ya, {mq.RESIDUAL} AS r FROM sp JOIN best_b USING (pair_id)), {mq.CELLS.replace('FROM m)', 'FROM f WHERE r <= 1.5)')},
k AS (SELECT pair_id, gy, gx, count(*) AS c FROM cells GROUP BY ALL), t AS (SELECT pair_id, sum(c) AS t FROM k GROUP BY pair_id),
u AS (SELECT pair_id, count(*) / 64.0::DOUBLE AS coverage, -sum((c / t) * ln(c / t)) / ln(64) AS entropy FROM k JOIN t USING (pair_id) GROUP BY pair_id),
s AS (SELECT pair_id, count(*) FILTER (r <= 1.5) AS inlier_count, count(*) FILTER (r <= 1.5) / count(*) AS ratio, sqrt(avg(r * r) FILTER (r <= 1.5)) AS rmse FROM f GROUP BY pair_id)
SELECT pair_id, matches, CASE WHEN matches >= 8 THEN inlier_count END AS inlier_count, round(CASE WHEN matches >= 8 THEN ratio END, 4) AS inlier_ratio, round(CASE WHEN matches >= 8 THEN rmse END, 4) AS rmse_px,
  round(CASE WHEN matches >= 8 THEN coalesce(coverage, 0) ELSE 0 END, 4) AS coverage, round(CASE WHEN matches >= 8 THEN coalesce(entropy, 0) ELSE 0 END, 4) + 0.0 AS entropy FROM n LEFT JOIN s USING (pair_id) LEFT JOIN u USING (pair_id)"""


@query(BASELINE)
def baseline_scores(spark, sf_dir):
    """Every tenth pair has five matches only."""
    ms = matches(spark, sf_dir).where((F.col("pair_id") % 10 != 3) | (F.col("match_id") < 5))
    return rounded(ev.fit_scores(ms, SIZE), 4)


def wide(sql: str) -> str:
    """The scores within three pixels, of at least three inliers."""
    return sql.replace("<= 1.5", "<= 3.0").replace("FROM f GROUP BY pair_id)", "FROM f GROUP BY pair_id HAVING count(*) FILTER (r <= 3.0) >= 3)").replace("matches >= 8 THEN coalesce", "matches >= 8 AND ratio IS NOT NULL THEN coalesce")


@query(wide(BASELINE))
def baseline_scores_wide(spark, sf_dir):
    ms = matches(spark, sf_dir).where((F.col("pair_id") % 10 != 3) | (F.col("match_id") < 5))
    return rounded(ev.fit_scores(ms, SIZE, least_inliers=3, cfg=replace(DEFAULT, ransac_px=3.0)), 4)


@query(f"WITH {MATCHES}, g AS (SELECT pair_id, CAST(pair_id % 3 AS VARCHAR) AS name, count(*) AS n FROM m GROUP BY pair_id) SELECT name, CAST(pair_id AS VARCHAR) AS tile, CAST(pair_id % 45 AS DOUBLE) AS tilt_deg, n AS n_correspondences FROM g WHERE n >= 64")
def training_manifest(spark, sf_dir):
    pair = F.col("pair_id")
    rows = matches(spark, sf_dir).select((pair % 3).cast("string").alias("name"), pair.cast("string").alias("tile"), (pair % 45).cast("double").alias("tilt_deg"), F.col("xb").alias("bx"), F.col("yb").alias("by"))
    return sinks.training_manifest(rows)


CHOICE = """rf AS (SELECT *, (tile_id * 17) % 91 AS incidence FROM tl), {near},
ov AS (SELECT product_id, incidence AS i FROM nr JOIN rf ON least(nr.east, rf.east) > greatest(nr.west, rf.west) AND least(nr.north, rf.north) > greatest(nr.south, rf.south)),
h AS (SELECT product_id, count(*) AS hits, CAST((count(*) FILTER (i < 30) >= 2) AS INT) + CAST((count(*) FILTER (i >= 30 AND i < 50) >= 2) AS INT) + CAST((count(*) FILTER (i >= 50 AND i < 70) >= 2) AS INT) + CAST((count(*) FILTER (i >= 70 AND i <= 90) >= 2) AS INT) AS illuminations FROM ov GROUP BY product_id)
SELECT product_id, hits, round(hits / (greatest(nr.east - nr.west, 1e-9) * greatest(nr.north - nr.south, 1e-9)), 6) AS density, illuminations, illuminations >= 2 AS multi, round({order}, 6) AS order_key FROM h JOIN nr USING (product_id)"""


def references(spark, sf_dir):
    return tiles(spark, sf_dir).withColumn("incidence", F.col("tile_id") * 17 % 91)


@query(f"WITH {FOOTPRINTS}, {TILES}, {CHOICE.format(near='nr AS (SELECT *, abs((south + north) / 2) AS o FROM fp WHERE abs((south + north) / 2) <= 20)', order='o')}")
def chosen_by_box(spark, sf_dir):
    return rounded(ct.pick_products(footprints(spark, sf_dir), references(spark, sf_dir), max_lat=20.0))


@query(f"""WITH {FOOTPRINTS}, {TILES}, {CHOICE.format(near='''nr AS (SELECT product_id, greatest(west, (west + east) / 2 - 0.5) AS west, least(east, (west + east) / 2 + 0.5) AS east, 4.5::DOUBLE AS south, 5.5::DOUBLE AS north,
  greatest(east - west, 1e-9) * greatest(north - south, 1e-9) AS o FROM fp WHERE 5 BETWEEN south AND north)''', order='o')}""")
def chosen_by_probe(spark, sf_dir):
    return rounded(ct.pick_products(footprints(spark, sf_dir), references(spark, sf_dir), at_lat=5.0))


@query(f"""WITH {rq.DEM}, {rq.NORM}, s AS (SELECT r, c, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {rq._mu0(*rq.SUN)})) AS s FROM nm)
SELECT s.r, s.c, round(px.v / greatest(s, 0.15::DOUBLE), 6) + 0.0 AS v FROM s JOIN px ON s.r = px.r AND s.c = px.c""")
def shading_clamped(spark, sf_dir):
    d = rq.dem(spark, sf_dir)
    return rq.rc(ra.divide_shading(d, ph.render(d, rq.SPACING, rq.SUN, law="lambert", shadows=False), clamp=0.15), "v")


@query(f"""WITH {rq.DEM}, {rq.NORM}, s AS (SELECT r, c, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {rq._mu0(*rq.SUN)})) AS s FROM nm), px0 AS (SELECT s.r, s.c, px.v / greatest(s, 0.15::DOUBLE) AS v FROM s JOIN px ON s.r = px.r AND s.c = px.c),
{rq._box(31).replace('FROM px', 'FROM px0')} SELECT r, c, round((v - m) / sqrt(greatest(m2 - m * m, 1e-6)), 5) + 0.0 AS contrast FROM bm""")
def shading_high_pass(spark, sf_dir):
    d = rq.dem(spark, sf_dir)
    return rq.rc(ra.high_pass_shading(d, ph.render(d, rq.SPACING, rq.SUN, law="lambert", shadows=False)), "contrast", n=5)


@query(f"""WITH {PIXELS}, {rq.GEOLOC}, l AS (SELECT min(r) AS a, max(r) AS b FROM gl WHERE c = (SELECT (max(c) + 1) // 2 FROM gl) AND lat BETWEEN 11.2 AND 11.9 HAVING count(*) >= 64)
SELECT CAST(r - a AS INT) AS r, CAST(63 - c AS INT) AS c, round(CASE WHEN v > 0.2 THEN 0 ELSE v * 2 END, 6) + 0.0 AS v FROM px, l WHERE r BETWEEN a AND b""")
def band_window(spark, sf_dir):
    """Two bands, the second of which is the nearer one; cells over 0.4 in it are NaN."""
    p = pixels(spark, sf_dir)
    second = p.withColumn("v", F.when(F.col("v") > 0.2, float("nan")).otherwise(F.col("v") * 2)).withColumn("band", F.lit(2))
    cube = p.withColumn("band", F.lit(1)).unionByName(second)
    bands = spark.createDataFrame([("src", 1, 750.0), ("src", 2, 1010.0)], "image_id string, band int, wavelength_nm double")
    return rq.rc(ge.band_lines(cube, bands, rq.geoloc(spark, sf_dir), 1000.0, 11.2, 11.9, mirrored=True), "v")


@query(f"""WITH {PIXELS}, d AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px), k AS (SELECT CAST(k AS INT) AS chunk, CAST(floor(greatest(0, h - 64) * k / 5) AS INT) AS row0, h, w FROM d, range(6) t(k)),
s AS (SELECT chunk, row0, count(*) FILTER (v > 0) / (least(64, h) * w) AS share FROM k JOIN px ON r BETWEEN row0 AND row0 + 63 GROUP BY chunk, row0, h, w) SELECT chunk, row0, round(share, 6) AS share FROM s WHERE share >= 0.49""")
def chunks_with_data(spark, sf_dir):
    return rounded(ge.valid_chunks(pixels(spark, sf_dir), 6, 64, 0.49).drop("image_id"))


@query("""WITH m AS (SELECT p_brand AS archive, p_partkey AS position, p_name || CASE WHEN p_size % 3 = 0 THEN '.tif' ELSE '.xml' END AS name FROM part) SELECT archive, arg_min(name, position) AS name FROM m WHERE name LIKE '%.tif' GROUP BY archive""")
def first_members(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".tif").otherwise(".xml"))
    return rasters.first_member(read(spark, sf_dir, "part").select(F.col("p_brand").alias("archive"), F.col("p_partkey").alias("position"), name.alias("name")), ".tif")


@query("""WITH m AS (SELECT p_brand AS archive, p_partkey AS position, p_name || CASE WHEN p_size % 3 = 0 THEN '.tif' ELSE '.xml' END AS name FROM part)
SELECT archive, name FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY contains(name, 'ring') DESC, position) AS k FROM m WHERE name LIKE '%.tif') WHERE k = 1""")
def preferred_members(spark, sf_dir):
    """The first member that is named for a match, else the first of all."""
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".tif").otherwise(".xml"))
    members = read(spark, sf_dir, "part").select(F.col("p_brand").alias("archive"), F.col("p_partkey").alias("position"), name.alias("name"))
    return rasters.first_member(members, ".tif", preferred="ring")


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS ends, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers FROM documents""")
def pattern_counts(spark, sf_dir):
    return dc.pattern_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", ends="[.!?]", numbers="[0-9]+").drop("text")


@query("SELECT 'a_oth_' || p_partkey AS id FROM part WHERE p_size % 4 = 0 OR p_partkey % 5 = 0 OR p_partkey % 9 = 0")
def unpaired_rasters(spark, sf_dir):
    """Orthos whose terrain model has another size, other bounds, or is not there."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    west, south = (k % 360).cast("double"), (k % 90).cast("double")
    ortho = p.select(F.concat(F.lit("a_oth_"), k.cast("string")).alias("id"), F.lit(400).alias("width"), F.lit(200).alias("height"), west.alias("west"), south.alias("south"))
    own = F.when(F.col("p_size") % 4 == 0, 201).otherwise(200)
    dtm = p.where(k % 9 != 0).select(F.concat(F.lit("a_dtm_"), k.cast("string")).alias("id"), own.alias("width"), F.lit(100).alias("height"), F.when(k % 5 == 0, west + 0.1).otherwise(west).alias("west"), south.alias("south"))
    return rasters.pair_violations(ortho, dtm)


def _skew_sql(tilt: float, phi_deg: float) -> str:
    phi = math.radians(phi_deg)
    s, c = repr(math.sin(phi)) + "::DOUBLE", repr(math.cos(phi)) + "::DOUBLE"
    weights = tr.blur_weights(0.8 * math.sqrt(tilt * tilt - 1))
    half = len(weights) // 2
    kernel = ", ".join(f"({i - half}, {k!r}::DOUBLE)" for i, k in enumerate(weights))
    xs = f"CAST(trunc({c} * w) AS INT), CAST(trunc({c} * w - {s} * h) AS INT), CAST(trunc(-{s} * h) AS INT), 0"
    ys = f"CAST(trunc({s} * w) AS INT), CAST(trunc({s} * w + {c} * h) AS INT), CAST(trunc({c} * h) AS INT), 0"
    return f"""WITH {PIXELS}, {rq.DIM}, bx AS (SELECT least({xs}) AS x0, least({ys}) AS y0, greatest({xs}) - least({xs}) + 1 AS w2, greatest({ys}) - least({ys}) + 1 AS h2 FROM dim),
ce AS (SELECT r, c, round({c} * (c + x0) + {s} * (r + y0), 9) AS sx, round({c} * (r + y0) - {s} * (c + x0), 9) AS sy FROM bx, range(w2) x(c), range(h2) y(r)),
ta AS (SELECT r, c, CAST(floor(sy) + i AS INT) AS pr, CAST(floor(sx) + j AS INT) AS pc, (1 - abs(sx - (floor(sx) + j))) * (1 - abs(sy - (floor(sy) + i))) AS k FROM ce, range(2) a(i), range(2) b(j)),
se AS (SELECT ta.r, ta.c, coalesce(sum(k * v), 0) AS v FROM ta LEFT JOIN px ON px.r = pr AND px.c = pc GROUP BY 1, 2), kn(d, k) AS (VALUES {kernel}),
ou AS (SELECT o, k, ((least(floor(o * {tilt!r}::DOUBLE), w2 - 1) + d) % (2 * (w2 - 1)) + 2 * (w2 - 1)) % (2 * (w2 - 1)) AS f, 2 * (w2 - 1) AS p FROM bx, range(CAST(round_even(w2 / {tilt!r}::DOUBLE, 0) AS INT)) t(o), kn)
SELECT CAST(r AS INT) AS r, CAST(o AS INT) AS c, round(sum(k * v), 6) + 0.0 AS v FROM ou JOIN se ON se.c = CAST(least(f, p - f) AS INT) GROUP BY r, o"""


@query(_skew_sql(2.0, 36.0))
def skew_views(spark, sf_dir):
    return rq.rc(tr.skew_view(pixels(spark, sf_dir), 2.0, 36.0), "v")
