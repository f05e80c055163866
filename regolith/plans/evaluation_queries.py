"""Queries of evaluations, windows and grids, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith.config import DEFAULT
from regolith.fixtures import FOOTPRINTS, MATCHES, PIXELS, SIZE, TILES, TRIPLES, footprints, matches, pixels, read, tiles, triples
from regolith.operators import catalog as ct
from regolith.operators import evaluation as ev
from regolith.operators import geometry as ge
from regolith.operators import match_metrics as mm
from regolith.operators import raster as ra
from regolith.plans import match_queries as mq
from regolith.plans import raster_queries as rq
from regolith.plans import registration
from regolith.plans.match_queries import rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {MATCHES} SELECT pair_id, CASE WHEN conf >= 0.5 THEN 'near' ELSE 'far' END AS origin, count(*) AS n, count(DISTINCT match_id) AS ids FROM m GROUP BY ALL")
def pooled_matches(spark, sf_dir):
    ms = matches(spark, sf_dir)
    both = ev.pooled({"near": ms.where("conf >= 0.5"), "far": ms.where("conf < 0.5")})
    return both.groupBy("pair_id", "origin").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("ids"))


@query(f"""WITH {MATCHES}, o AS (SELECT pair_id % 5 AS method, pair_id AS win, count(*) AS n, median(xb - xa) AS dx, median(yb - ya) AS dy FROM m GROUP BY ALL),
k AS (SELECT method, n, CASE WHEN n >= 8 THEN dx END AS dx, CASE WHEN n >= 8 THEN dy END AS dy FROM o WHERE method <> 3)
SELECT method, count(*) AS windows, round(avg(n), 6) AS mean_matches, round(CASE WHEN count(dx) >= 2 THEN sqrt(pow(stddev_pop(dx), 2) + pow(stddev_pop(dy), 2)) END, 6) AS spread FROM k GROUP BY method""")
def method_evaluation(spark, sf_dir):
    """A method for each fifth pair, its pairs as windows; one method's gate has not passed."""
    ms = matches(spark, sf_dir).withColumn("method", F.col("pair_id") % 5).withColumn("window", F.col("pair_id"))
    gates = ms.select("method", (F.col("method") != 3).alias("passed")).distinct()
    return rounded(registration.evaluate(ms, gates))


LADDER = f"""WITH {MATCHES}, {mq.RES}, {mq.CELLS.replace('FROM m)', 'FROM res WHERE r <= 1.5)')},
o AS (SELECT pair_id, count(*) AS n, CASE WHEN count(*) >= 8 THEN median(xb - xa) END AS dx, CASE WHEN count(*) >= 8 THEN median(yb - ya) END AS dy, count(*) FILTER (r <= 1.5) / count(*) AS ratio,
  sqrt(avg(r * r) FILTER (r <= 1.5)) AS rmse, count(*) FILTER (conf < 0.1) AS noise_n FROM res GROUP BY pair_id),
cv AS (SELECT pair_id, count(DISTINCT gy * 8 + gx) / 64.0::DOUBLE AS cov FROM cells GROUP BY pair_id),
w AS (SELECT 1 << CAST(pair_id % 5 AS INT) AS k, n, ratio, rmse, coalesce(cov, 0) AS cov, dx, dy, noise_n, dx IS NOT NULL AND rmse IS NOT NULL AS ok FROM o LEFT JOIN cv USING (pair_id))
SELECT CAST(k AS INT) AS k, count(*) FILTER (ok) AS windows, round(avg(n) FILTER (ok), 6) AS mean_n, round(avg(ratio) FILTER (ok), 6) AS mean_inlier_ratio, round(avg(rmse) FILTER (ok), 6) AS mean_rmse, round(avg(cov) FILTER (ok), 6) AS mean_coverage,
  round(sqrt(pow(stddev_pop(dx) FILTER (ok), 2) + pow(stddev_pop(dy) FILTER (ok), 2)), 6) AS spread, round(sum(n) / greatest(sum(noise_n), 1), 6) AS noise_ratio, sum(n) / greatest(sum(noise_n), 1) >= 5 AS passed
FROM w GROUP BY k HAVING count(*) FILTER (ok) >= 2"""


@query(LADDER)
def scale_ladder(spark, sf_dir):
    ms = matches(spark, sf_dir)
    fitted = mm.residuals(ms, mq.truth(ms)).withColumn("inlier", F.col("residual") <= DEFAULT.ransac_px)
    metrics = mm.summarise(fitted, SIZE, 4).select("pair_id", "inlier_ratio", F.col("rmse_px").alias("rmse"), "coverage")
    noise = ms.groupBy("pair_id").agg(F.count_if(F.col("conf") < 0.1).alias("noise_n"))
    rows = mm.offset_mad(ms).join(metrics, "pair_id").join(noise, "pair_id").withColumn("k", F.pow(F.lit(2), F.col("pair_id") % 5).cast("int"))
    return rounded(ev.scale_ladder(rows))


@query(f"""WITH {MATCHES}, s AS (SELECT pair_id, CAST(floor(ya / 32) * 32 AS INT) AS row0, count(*) AS n FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, row0) AS k FROM s)
SELECT pair_id, max(row0) FILTER (k = 1) AS row0, max(n) AS best, min(n) AS least, median(n) AS middle, round(max(n) / greatest(median(n), 1), 6) AS peak, max(n) / greatest(median(n), 1) >= 3 AS found FROM b GROUP BY pair_id""")
def overlap_profile(spark, sf_dir):
    scores = matches(spark, sf_dir).groupBy("pair_id", (F.floor(F.col("ya") / 32) * 32).cast("int").alias("row0")).agg(F.count("*").alias("matches"))
    return rounded(registration.locate_overlap(scores))


@query(f"""WITH {MATCHES}, {mq.RES}, r AS (SELECT pair_id, CAST(pair_id % 4 AS INT) AS variant, CASE WHEN pair_id % 9 = 0 THEN NULL ELSE sqrt(avg(r * r) FILTER (r <= 1.5)) END AS rmse, count(*) FILTER (r <= 1.5) / count(*) AS share FROM res GROUP BY pair_id)
SELECT variant, count(*) AS runs, round(avg(rmse), 6) AS rmse, round(avg(share), 6) AS coverage, round(avg(share * share), 6) AS entropy, coalesce(avg(rmse) < 1, false) AS sub_pixel FROM r GROUP BY variant""")
def variant_table(spark, sf_dir):
    ms = matches(spark, sf_dir)
    near = F.col("residual") <= DEFAULT.ransac_px
    g = mm.residuals(ms, mq.truth(ms)).groupBy("pair_id").agg(F.sqrt(F.avg(F.when(near, F.col("residual") * F.col("residual")))).alias("rmse"), (F.count_if(near) / F.count("*")).alias("coverage"))
    g = g.withColumn("rmse", F.when(F.col("pair_id") % 9 == 0, float("nan")).otherwise(F.col("rmse"))).withColumn("variant", (F.col("pair_id") % 4).cast("int"))
    return rounded(ev.variant_table(g.withColumn("entropy", F.col("coverage") * F.col("coverage"))))


@query(f"WITH x AS ({mq.SQL['select_model']}) SELECT count(*) AS pairs, count(*) FILTER (best = 'affine') AS chosen, count(*) FILTER (best = 'affine') <= count(*) // 2 AS passed FROM x")
def complexity_control(spark, sf_dir):
    return ev.complexity_control(mq.select_model(spark, sf_dir), "affine")


@query("""WITH b AS (SELECT o_custkey AS "case", count(*) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_custkey AS "case", count(*) AS m, avg(o_totalprice) / 200000 AS r FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
g AS (SELECT c_custkey AS "case", c_nationkey % 2 = 0 AS b, c_nationkey % 3 = 0 AS a FROM customer)
SELECT b."case", b.m AS b_matches, c.m AS matches, CASE WHEN c.m IS NULL THEN 'no result' WHEN r > 1 THEN 'rmse over one pixel' WHEN c.m < 0.5 * b.m THEN 'matches halved' WHEN coalesce(g.b, false) AND NOT coalesce(g.a, false) THEN 'gate lost' ELSE 'adopt' END AS verdict
FROM b LEFT JOIN c ON b."case" = c."case" LEFT JOIN g ON b."case" = g."case\"""")
def adoption_with_gate(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    runs = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("case")).agg(F.count("*").alias("matches"), (F.avg("o_totalprice") / 200000).alias("rmse_px"))
    gates = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), (F.col("c_nationkey") % 2 == 0).alias("before"), (F.col("c_nationkey") % 3 == 0).alias("after"))
    return ev.adoption(runs(0), runs(1), gates)


@query("""WITH f AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'tmc2' ELSE 'nac-M' || (p_size % 7) END || '_' || p_partkey || '_' || p_size || '_07' AS stem FROM part),
s AS (SELECT stem, regexp_replace(stem, '(_[^_]*){3}$', '') AS scene FROM f), h AS (SELECT coalesce(max(scene) FILTER (scene LIKE 'nac%'), max(scene)) AS held FROM s) SELECT stem, scene, scene = held AS validation FROM s, h""")
def scene_hold_out(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    scene = F.when(F.col("p_size") % 3 == 0, F.lit("tmc2")).otherwise(F.concat(F.lit("nac-M"), (F.col("p_size") % 7).cast("string")))
    return ev.hold_out_scene(p.select(F.concat_ws("_", scene, F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit("07")).alias("stem")))


@query(f"WITH {FOOTPRINTS} SELECT instrument, count(*) AS unfiltered, count(*) FILTER ((south + north) / 2 BETWEEN 0 AND 20) AS filtered, count(*) FILTER ((south + north) / 2 BETWEEN 0 AND 20) < count(*) AS bites FROM fp GROUP BY instrument")
def filter_check(spark, sf_dir):
    return ev.filter_bites(footprints(spark, sf_dir), "instrument", ((F.col("south") + F.col("north")) / 2).between(0, 20))


@query(f"""WITH {TRIPLES}, k AS (SELECT tile // 2 AS box, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c FROM tr GROUP BY 1)
SELECT box, least(a, b, c) AS least, greatest(a, b, c) AS most, CASE WHEN least(a, b, c) = 0 THEN 'none' WHEN least(a, b, c) = greatest(a, b, c) THEN 'complete' ELSE 'partial' END AS verdict FROM k""")
def coverage_verdicts(spark, sf_dir):
    return ev.coverage_verdict(triples(spark, sf_dir).withColumn("box", F.floor(F.col("tile") / 2)), "box")


@query(f"""WITH {FOOTPRINTS}, {TILES}, ov AS (SELECT product_id, count(*) AS hits FROM fp JOIN tl ON least(fp.east, tl.east) > greatest(fp.west, tl.west) AND least(fp.north, tl.north) > greatest(fp.south, tl.south) GROUP BY 1)
SELECT product_id, hits, round(abs((south + north) / 2), 6) AS order_key FROM fp JOIN ov USING (product_id) ORDER BY abs((south + north) / 2), product_id LIMIT 20""")
def first_products(spark, sf_dir):
    """The twenty products that are shown: a report's limit, counted over products with hits only."""
    ranked = ct.rank_products(footprints(spark, sf_dir), tiles(spark, sf_dir))
    return rounded(ev.first_with_hits(ranked, 20).select("product_id", "hits", "order_key"))


@query("""SELECT s_nationkey % 4 || 'I' AS iid, 2 * count(*) AS types, CAST(sum(s_suppkey) AS BIGINT) AS products, count(*) FILTER (s_suppkey % 3 = 0) AS searchable FROM supplier GROUP BY 1""")
def product_type_tally(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    iid, n = F.concat((F.col("s_nationkey") % 4).cast("string"), F.lit("I")), F.col("s_suppkey").cast("string")
    flag = F.when(F.col("s_suppkey") % 3 == 0, "T").otherwise("F")
    one = F.struct(F.lit("A").alias("PT"), iid.alias("IID"), n.alias("NumberProducts"), F.lit("T").alias("ValidFootprints"), flag.alias("ValidIncidenceAngles"))
    two = F.struct(F.lit("B").alias("PT"), iid.alias("IID"), F.struct(F.lit(1).alias("x")).alias("more"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(one.alias("deep"))).alias("list"), two.alias("other")).alias("ODEResults")))
    return ev.type_tally(ev.product_types(s.select(doc.alias("json"))))


@query(f"WITH {PIXELS}, {rq.GEOLOC} SELECT CAST(min(r) AS INT) AS first, CAST(max(r) AS INT) AS last, count(*) AS lines FROM gl WHERE c = (SELECT (max(c) + 1) // 2 FROM gl) AND lat BETWEEN 11.2 AND 11.9 AND lon BETWEEN 9 AND 10 HAVING count(*) >= 128")
def tile_lines(spark, sf_dir):
    return ge.lines_in_tile(rq.geoloc(spark, sf_dir), 9.0, 10.0, 11.2, 11.9).select("first", "last", "lines")


@query(f"""WITH {PIXELS}, d AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px), z AS (SELECT least(200, h - 32) AS row0, w FROM d),
s AS (SELECT row0, w, min(c) AS a, max(c) AS b, count(DISTINCT c) AS columns FROM px, z WHERE v > 0.05 AND r >= row0 AND r < row0 + 8 GROUP BY ALL)
SELECT CAST(row0 AS INT) AS row0, CAST(greatest(0, least(w - 32, (a + b) // 2 - 16)) AS INT) AS col0, columns FROM s WHERE columns >= 32""")
def strip_corner(spark, sf_dir):
    imaged = pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0))
    return ge.strip_window(imaged, 200, 32).select("row0", "col0", "columns")


@query(f"""WITH {PIXELS}, t AS (SELECT r, c, v + 1 AS v FROM px), b AS (SELECT * FROM range(120) y(r), range(70) x(c))
SELECT CAST(b.r AS INT) AS r, CAST(b.c AS INT) AS c, round(coalesce(v, 0), 6) + 0.0 AS v FROM b LEFT JOIN t ON t.r = b.r + 50 AND t.c = b.c + 4""")
def box_window(spark, sf_dir):
    """A box of 120 x 70 cells that runs past the raster's edge; the first of the tiles lies elsewhere."""
    p = pixels(spark, sf_dir, "b").withColumn("v", F.col("v") + 1)
    t = spark.createDataFrame([("a", 500.0, 900.0, 0.5), ("b", 10.0, 100.0, 0.5)], "image_id string, west double, north double, step double")
    return rq.rc(ge.reference_window(t, p, 12.0, 15.0, 47.0, 75.0), "v")


@query(f"WITH {PIXELS}, g AS (SELECT r, c, CASE WHEN v > 0.5 THEN NULL ELSE v END AS v FROM px) SELECT r, c, round(coalesce(v, (SELECT avg(v) FROM g)), 6) + 0.0 AS v FROM g")
def fill_no_data(spark, sf_dir):
    p = pixels(spark, sf_dir)
    marked = p.withColumn("v", ra.no_data(F.when(F.col("v") > 0.5, F.lit(-9999.0)).otherwise(F.col("v")), -9999.0))
    return rq.rc(ra.fill_mean(marked), "v")


@query(f"WITH {PIXELS} SELECT r, c, round(degrees((90000 - 7.403::DOUBLE * (r + 0.5)) / 1737400.0::DOUBLE), 9) + 0.0 AS lat, round(degrees((1000 + 7.403::DOUBLE * (c + 0.5)) / 1737400.0::DOUBLE), 9) + 0.0 AS lon FROM px")
def cell_positions(spark, sf_dir):
    lat, lon = ge.pixel_latlon(F.col("r"), F.col("c"), [7.403, 0.0, 1000.0, 0.0, -7.403, 90000.0])
    return rounded(pixels(spark, sf_dir).select("r", "c", lat.alias("lat"), lon.alias("lon")), 9)


@query("SELECT p_partkey AS image_id, CAST(i AS INT) AS chunk, CAST(greatest(0, p_size * 100 - 512) * i // 4 AS INT) AS row0 FROM part, range(5) t(i)")
def row_chunks(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 100).alias("height"))
    return ge.chunks(p, 5, 512)


RADII = "1737400.0::DOUBLE"


@query(f"""WITH {TILES}, s AS (SELECT *, degrees(2000 / {RADII}) AS step FROM tl), d AS (SELECT *, CAST(greatest(1, round_even((east - west) / step, 0)) AS INT) AS w, CAST(greatest(1, round_even((north - south) / step, 0)) AS INT) AS h FROM s)
SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(west + (c + 0.5) * step, 9) + 0.0 AS lon, round(north - (r + 0.5) * step, 9) + 0.0 AS lat FROM (SELECT min(west) AS west, max(north) AS north, any_value(step) AS step, any_value(w) AS w, any_value(h) AS h FROM d), range(w) x(c), range(h) y(r)""")
def grid_of_centres(spark, sf_dir):
    """The grid of a tile's size at the corner of all tiles."""
    west, north = tiles(spark, sf_dir).agg(F.min("west"), F.max("north")).first()
    return rounded(ge.target_grid(spark, west, north - 3, west + 3, north, 2000.0), 9)


@query()
def fit_degrees(spark, sf_dir):
    g = rq.geoloc(spark, sf_dir)
    height, width = g.agg(F.max("r") + 1, F.max("c") + 1).first()
    return rounded(ge.degree_sweep(g, g.select("lon", "lat"), height, width), 3)


CUBIC = """gs AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w, CAST(greatest(1, round_even((max(r) + 1) / 0.7::DOUBLE, 0)) AS INT) AS oh, CAST(greatest(1, round_even((max(c) + 1) / 0.7::DOUBLE, 0)) AS INT) AS ow FROM px),
ar AS (SELECT o, greatest(0, least(h - 1, CAST(floor(s) AS INT) + j)) AS r, s - (floor(s) + j) AS d FROM (SELECT h, o, (o + 0.5) * (h / oh::DOUBLE) - 0.5 AS s FROM gs, range(oh) t(o)), range(-1, 3) u(j)),
ac AS (SELECT o, greatest(0, least(w - 1, CAST(floor(s) AS INT) + j)) AS c, s - (floor(s) + j) AS d FROM (SELECT w, o, (o + 0.5) * (w / ow::DOUBLE) - 0.5 AS s FROM gs, range(ow) t(o)), range(-1, 3) u(j)),"""


@query(f"""WITH {PIXELS}, {CUBIC} g1 AS (SELECT ar.o AS r, c, sum(({rq._cubic('d')}) * v) AS v FROM px JOIN ar ON px.r = ar.r GROUP BY 1, 2),
g2 AS (SELECT g1.r, ac.o AS c, sum(({rq._cubic('d')}) * v) AS v FROM g1 JOIN ac ON g1.c = ac.c GROUP BY 1, 2) SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(v, 6) + 0.0 AS v FROM g2""")
def resample_grow(spark, sf_dir):
    return rq.rc(ra.resample_area(pixels(spark, sf_dir), 0.7), "v")
