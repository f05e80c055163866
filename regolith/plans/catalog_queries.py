"""Queries over product catalogues, labels and reports, and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from regolith.fixtures import FOOTPRINTS, TILES, TRIPLES, footprints, read, tiles, triples
from regolith.functions.tables import shared_dir
from regolith.operators import catalog as ct
from regolith.operators import evaluation as ev
from regolith.operators.geometry import pixel_size_m
from regolith.operators.photometry import compass
from regolith.streaming.arrivals import arrivals
from regolith.plans.match_queries import rounded
from regolith.sources import catalogues as cs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OVER = "ov AS (SELECT product_id, instrument, tile_id, (least(fp.east, tl.east) - greatest(fp.west, tl.west)) * (least(fp.north, tl.north) - greatest(fp.south, tl.south)) AS area FROM fp JOIN tl ON least(fp.east, tl.east) > greatest(fp.west, tl.west) AND least(fp.north, tl.north) > greatest(fp.south, tl.south))"


@query(f"""WITH {FOOTPRINTS} SELECT product_id, CASE WHEN instrument = 'MACHINERY' AND product_id % 3 = 0 THEN NULL ELSE round(west, 6) END AS west, CASE WHEN instrument = 'MACHINERY' AND product_id % 3 = 0 THEN NULL ELSE round(east, 6) END AS east,
CASE WHEN instrument = 'MACHINERY' AND product_id % 3 = 0 THEN NULL ELSE round(south, 6) + 0.0 END AS south, CASE WHEN instrument = 'MACHINERY' AND product_id % 3 = 0 THEN NULL ELSE round(north, 6) + 0.0 END AS north FROM fp""")
def footprint_bbox(spark, sf_dir):
    """Corners as text, one of them unreadable for an instrument; every third of these has but one readable corner."""
    fp = footprints(spark, sf_dir)
    bad, worse = F.col("instrument") == "MACHINERY", (F.col("instrument") == "MACHINERY") & (F.pmod("product_id", F.lit(3)) == 0)
    text = lambda c: F.col(c).cast("string")
    records = fp.select(
        "product_id", F.when(bad, "n/a").otherwise(text("north")).alias("UL_LAT"), text("west").alias("UL_LON"),
        F.when(worse, "?").otherwise(text("north")).alias("UR_LAT"), F.when(worse, "?").otherwise(text("east")).alias("UR_LON"),
        F.when(worse, "").otherwise(text("south")).alias("BL_LAT"), F.when(worse, F.lit(None)).otherwise(text("west")).alias("BL_LON"), text("south").alias("BR_LAT"), text("east").alias("BR_LON"),
    )
    return rounded(ct.bbox(records).select("product_id", "west", "east", "south", "north"))


@query(f"""WITH {FOOTPRINTS}, p AS (SELECT product_id, (west + east) / 2 AS lon, west, east FROM fp WHERE 0 BETWEEN south AND north)
SELECT product_id, round(greatest(west, lon - 0.5), 6) AS west, round(least(east, lon + 0.5), 6) AS east, -0.5::DOUBLE AS south, 0.5::DOUBLE AS north FROM p""")
def probe_boxes(spark, sf_dir):
    return rounded(ct.probe_box(footprints(spark, sf_dir), 0.0))


BAND = "CASE WHEN (south + north) / 2 < -60 THEN 'south polar' WHEN (south + north) / 2 < -20 THEN 'south mid' WHEN (south + north) / 2 <= 20 THEN 'equatorial' WHEN (south + north) / 2 <= 60 THEN 'north mid' ELSE 'north polar' END"


@query(f"WITH {FOOTPRINTS} SELECT instrument, {BAND} AS band, count(*) AS products FROM fp GROUP BY ALL")
def band_histogram(spark, sf_dir):
    return ct.band_histogram(footprints(spark, sf_dir))


@query("""WITH b AS (SELECT CASE WHEN p_size * 1.8::DOUBLE < 30 THEN 0 WHEN p_size * 1.8::DOUBLE < 50 THEN 1 WHEN p_size * 1.8::DOUBLE < 70 THEN 2 WHEN p_size * 1.8::DOUBLE <= 90 THEN 3 END AS bin FROM part),
c AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin) SELECT CAST(bin AS INT) AS bin, CAST([0, 30, 50, 70][bin + 1] AS INT) AS lo, CAST([30, 50, 70, 90][bin + 1] AS INT) AS hi, n, (SELECT count(*) FILTER (n >= 2) >= 2 FROM c) AS multi FROM c""")
def incidence_histogram(spark, sf_dir):
    return ct.incidence_histogram(read(spark, sf_dir, "part").withColumn("angle", F.col("p_size") * 1.8), "angle")


@query(f"WITH {FOOTPRINTS}, {TILES}, {OVER} SELECT product_id, tile_id, round(area, 6) AS area FROM ov")
def overlap_rank(spark, sf_dir):
    return ct.overlap(footprints(spark, sf_dir), tiles(spark, sf_dir), digits=6).select("product_id", "tile_id", "area")


@query(f"WITH {FOOTPRINTS}, {TILES} SELECT product_id, min(tile_id) AS tile_id FROM fp JOIN tl ON tl.west <= fp.west AND tl.east >= fp.east AND tl.south <= fp.south AND tl.north >= fp.north GROUP BY product_id")
def containment_first(spark, sf_dir):
    return ct.containing_tile(footprints(spark, sf_dir), tiles(spark, sf_dir))


@query(f"WITH {FOOTPRINTS}, {TILES} SELECT product_id, min(tile_id) AS tile_id FROM fp JOIN tl ON tl.west <= fp.west AND tl.east >= fp.east AND tl.south <= fp.south GROUP BY product_id")
def containment_without_north(spark, sf_dir):
    return ct.containing_tile(footprints(spark, sf_dir), tiles(spark, sf_dir), check_north=False)


@query(f"""WITH {FOOTPRINTS}, {TILES}, {OVER}, h AS (SELECT product_id, count(*) AS hits, sum(area) AS covered FROM ov GROUP BY product_id)
SELECT product_id, hits, round(covered, 6) AS covered, round(hits / (greatest(east - west, 1e-9) * greatest(north - south, 1e-9)), 6) AS density, round(abs((south + north) / 2), 6) AS order_key FROM h JOIN fp USING (product_id)""")
def product_ranking(spark, sf_dir):
    return rounded(ct.rank_products(footprints(spark, sf_dir), tiles(spark, sf_dir)))


@query(f"WITH {TRIPLES} SELECT tile, sum(kbytes)::BIGINT AS kbytes FROM tr GROUP BY tile HAVING count(DISTINCT kind) = 3")
def complete_triples(spark, sf_dir):
    return ct.complete_tiles(triples(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT tile, count(DISTINCT kind) AS kinds, CASE WHEN count(DISTINCT kind) = 3 THEN 'complete' ELSE 'partial' END AS verdict FROM tr GROUP BY tile")
def triple_completeness(spark, sf_dir):
    return ct.completeness(triples(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT tile, path, kbytes FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY kbytes DESC, path) AS k FROM tr WHERE path LIKE '%ring' AND lower(path) NOT LIKE '%small%') WHERE k = 1")
def largest_file(spark, sf_dir):
    return ct.largest_file(triples(spark, sf_dir), "ring", "small")


@query(f"WITH {TRIPLES}, x AS (SELECT tile, 'kbytes' AS field, kbytes::VARCHAR AS value FROM tr UNION ALL SELECT tile, 'kind', kind::VARCHAR FROM tr) SELECT tile, field, count(DISTINCT value) AS values FROM x GROUP BY ALL HAVING count(DISTINCT value) > 1".replace("AS values", 'AS "values"'))
def grid_mismatch(spark, sf_dir):
    return ct.grid_mismatches(triples(spark, sf_dir), "tile", ("kbytes", "kind"))


@query(f"WITH {TRIPLES} SELECT DISTINCT a.tile FROM tr a WHERE kind = 0 AND tile NOT IN (SELECT tile FROM tr WHERE kind = 2)")
def missing_elevation(spark, sf_dir):
    files = triples(spark, sf_dir)
    keys = lambda k: files.where(F.col("kind") == k).select("tile").distinct()
    return ct.missing(keys(0), keys(2), "tile")


@query("SELECT s_suppkey AS id, 'NAME' AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'SIZE', s_nationkey::VARCHAR FROM supplier UNION ALL SELECT s_suppkey, 'NOTE', 'a = b' FROM supplier")
def label_parse(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    text = F.concat(F.lit('NAME = "'), "s_name", F.lit('"\r\n/* no pair */\n  SIZE='), F.col("s_nationkey").cast("string"), F.lit("\nNAME = second\nNOTE = a = b\nEND\n"))
    return s.select(F.col("s_suppkey").alias("id"), F.explode(ct.parse_label(text)).alias("p")).select("id", "p.key", "p.value")


@query("SELECT s_suppkey AS id, [CAST(s_nationkey AS DOUBLE), 1504.5, 20.0] AS wavelengths FROM supplier")
def wavelength_list(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    text = F.concat(F.lit("bands = 3\nwavelength = {\n "), F.col("s_nationkey").cast("string"), F.lit(",1504.5 , x,\n 2e1}\nfwhm = {1}"))
    return s.select(F.col("s_suppkey").alias("id"), ct.number_list(text, "wavelength").alias("wavelengths"))


@query("SELECT p_partkey AS product_id, 'f' || i AS \"FileName\", 'u' || p_partkey AS \"URL\", CAST(p_size AS DOUBLE) AS kbytes FROM part, range(2) t(i) WHERE i < 1 + p_partkey % 2")
def json_product_files(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    one = lambda i: F.struct(F.lit(f"f{i}").alias("FileName"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("URL"), F.col("p_size").cast("string").alias("KBytes"))
    single = F.to_json(F.struct(F.struct(one(0).alias("Product_file")).alias("Product_files")))
    many = F.to_json(F.struct(F.struct(F.array(one(0), one(1)).alias("Product_file")).alias("Product_files")))
    return ct.product_files(p.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 2 == 0, single).otherwise(many).alias("json")))


@query("""WITH r AS (SELECT user_id AS file, ['real pair', 'roll +15 raw', 'noise', 'constant'][1 + event_id % 4] AS name, bool_and(value > 0.5 OR event_id % 7 <> 0) AS passed FROM events GROUP BY ALL)
SELECT file, CASE WHEN bool_or(name = 'real pair' AND NOT passed) THEN 'failed' WHEN count(DISTINCT name) < 4 THEN 'malformed' WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS verdict, count(DISTINCT name) AS checks FROM r GROUP BY file""")
def gate_report_audit(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    names = F.array(*map(F.lit, CHECKS))
    reports = e.groupBy(F.col("user_id").alias("file"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("name")).agg(F.bool_and((F.col("value") > 0.5) | (F.col("event_id") % 7 != 0)).alias("passed"))
    return ct.gate_audit(reports, CHECKS)


CHECKS = ("real pair", "roll +15 raw", "noise", "constant")


@query("""WITH b AS (SELECT o_custkey AS "case", count(*) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_custkey AS "case", count(*) AS m, avg(o_totalprice) / 200000 AS r FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT b."case", b.m AS b_matches, c.m AS matches, CASE WHEN c.m IS NULL THEN 'no result' WHEN r > 1 THEN 'rmse over one pixel' WHEN c.m < 0.5 * b.m THEN 'matches halved' ELSE 'adopt' END AS verdict FROM b LEFT JOIN c ON b."case" = c."case\"""")
def adoption_verdict(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    g = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("case")).agg(F.count("*").alias("matches"), (F.avg("o_totalprice") / 200000).alias("rmse_px"))
    return ev.adoption(g(0), g(1))


@query("""WITH h AS (SELECT user_id AS run, event_id AS epoch, value AS p, event_id % 100 AS real FROM events),
x AS (SELECT *, max(p) FILTER (real >= 40) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT run, epoch, p > greatest(coalesce(before, 0.1), 0.1) AND real >= 40 AS accepted FROM x""")
def epoch_acceptance(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_prec"), (F.col("event_id") % 100).alias("real_matches"))
    return ct.accepted_epochs(e, 0.1, 50.0).select("run", "epoch", "accepted")


@query("SELECT s_suppkey, CASE WHEN s_name LIKE '%1' THEN s_name ELSE s_name || '1' END AS name FROM supplier WHERE lower(s_name) LIKE '%plier%'")
def catalogue_search(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return ct.search(s, "PLIER").select("s_suppkey", ct.repaired_name(F.col("s_name"), "1").alias("name"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN radians(0.000244135::DOUBLE * (1 + c_nationkey)) * 1737400 ELSE 5.05::DOUBLE * (1 + c_nationkey) END, 6) AS gsd_m, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor(((c_nationkey * 31.0) % 360 + 22.5) / 45) AS INT) % 8 + 1] AS sector FROM customer")
def pixel_sizes(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    geographic = F.col("c_custkey") % 2 == 1
    a = F.when(geographic, -0.000244135 * (1 + F.col("c_nationkey"))).otherwise(5.05 * (1 + F.col("c_nationkey")))
    crs = F.when(F.col("c_custkey") % 5 != 0, "moon")
    return rounded(c.select("c_custkey", pixel_size_m(a, F.lit(False), crs, geographic).alias("gsd_m"), compass(F.col("c_nationkey") * 31.0).alias("sector")))



@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS scenes, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def scene_arrivals(spark, sf_dir):
    return rounded(arrivals(read(spark, sf_dir, "events")))


@query(f"WITH {FOOTPRINTS} SELECT product_id, round(west, 6) AS west, round(east, 6) AS east, round(south, 6) + 0.0 AS south, round(north, 6) + 0.0 AS north FROM fp WHERE south <= 6.5 AND north >= -4.25 AND (west <= 7.5 OR east >= 48)")
def catalogue_box(spark, sf_dir):
    """A box across the meridian, asked of a snapshot of the footprints."""
    kept = cs.snapshot(spark, f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}", lambda: footprints(spark, sf_dir))
    return rounded(cs.within(kept, 48.0, -4.25, 7.5, 6.5).select("product_id", "west", "east", "south", "north"))


@query(f"WITH {FOOTPRINTS} SELECT 'a' || (product_id % 7) AS page, CAST(product_id AS VARCHAR) AS product_id, instrument AS kind, CASE WHEN product_id % 5 = 0 THEN NULL ELSE round(west, 6) END AS west, round(east, 6) AS east FROM fp")
def catalogue_answers(spark, sf_dir):
    """JSON answers of many products each; every fifth product has no western edge that can be read."""
    fp = footprints(spark, sf_dir).withColumn("page", F.concat(F.lit("a"), (F.col("product_id") % 7).cast("string")))
    west = F.when(F.col("product_id") % 5 == 0, "n/a").otherwise(F.col("west").cast("string"))
    values = {"product_id": F.col("product_id").cast("string"), "kind": F.col("instrument"), "west": west, **{c: F.col(c).cast("string") for c in ("east", "south", "north")}}
    one = F.struct(*(v.alias(cs.FIELDS[k]) for k, v in values.items()))
    # answers of at most a hundred products, as a catalogue gives them
    whole = fp.groupBy("page", F.floor(F.col("product_id") / 700)).agg(F.collect_list(one).alias("Product"))
    answers = whole.select("page", F.to_json(F.struct(F.struct(F.struct("Product").alias("Products"), F.lit("OK").alias("Status")).alias("ODEResults"))).alias("text"))
    return rounded(cs.products(answers).select("page", "product_id", "kind", "west", "east"))
