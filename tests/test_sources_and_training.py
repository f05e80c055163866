"""Readers, writers and training operators on small inputs with known answers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from regolith.operators import catalog, geometry, training
from regolith.sources import rasters, sinks

PIXELS = "image_id string, r int, c int, v double"


def cells(spark, height, width, value=lambda r, c: float(r * 10 + c), image_id="a"):
    return spark.createDataFrame([(image_id, r, c, value(r, c)) for r in range(height) for c in range(width)], PIXELS)


def test_read_first_takes_the_sample_where_there_is_no_more(spark, tmp_path):
    cells(spark, 2, 2).write.parquet(str(tmp_path / "sample"))
    assert rasters.read_first(spark, str(tmp_path / "full"), str(tmp_path / "sample")).count() == 4
    cells(spark, 3, 2).write.parquet(str(tmp_path / "full"))
    assert rasters.read_first(spark, str(tmp_path / "full"), str(tmp_path / "sample")).count() == 6
    with pytest.raises(FileNotFoundError):
        rasters.read_first(spark, str(tmp_path / "none"))


def test_labels_and_footprints_name_their_files(spark, tmp_path):
    (tmp_path / "x.lbl").write_text("A = 1\nB = 2\n")
    assert [tuple(r) for r in rasters.read_labels(spark, str(tmp_path / "x.lbl")).collect()] == [("x.lbl", "A = 1\nB = 2\n")]
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "fp"))
    names = {r["_file"] for r in rasters.read_footprints(spark, str(tmp_path / "fp")).collect()}
    assert len(names) == 1 and names.pop().endswith(".parquet")


def test_members_and_pairs(spark):
    members = spark.createDataFrame([("z", 2, "b.img"), ("z", 1, "a.img"), ("z", 0, "a.xml"), ("y", 0, "q.xml")], "archive string, position int, name string")
    assert [tuple(r) for r in rasters.first_member(members, ".img").collect()] == [("z", "a.img")]
    assert rasters.archive_path("d/x.zip", "in/y.img") == "/vsizip/d/x.zip/in/y.img"
    schema = "id string, width int, height int, west double, south double"
    ortho = spark.createDataFrame([("a_oth_1", 4, 2, 0.0, 0.0), ("a_oth_2", 4, 2, 0.0, 0.0), ("a_oth_3", 4, 2, 0.0, 0.0)], schema)
    dtm = spark.createDataFrame([("a_dtm_1", 2, 1, 0.0, 0.0), ("a_dtm_2", 2, 2, 0.0, 0.0)], schema)
    assert {r["id"] for r in rasters.pair_violations(ortho, dtm).collect()} == {"a_oth_2", "a_oth_3"}


def test_points_metrics_and_training_pairs_come_back(spark, tmp_path):
    fitted = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0, 0.5, 0.25, True)], "pair_id int, match_id int, xa double, ya double, xb double, yb double, conf double, residual double, inlier boolean")
    sinks.write_match_points(fitted, str(tmp_path / "points"))
    back = spark.read.csv(str(tmp_path / "points"), header=True).first()
    assert (back["source_x"], back["residual_px"], back["inlier"], int(back["pair_id"])) == ("1.0000", "0.2500", "1", 1)
    sinks.write_metrics(spark.createDataFrame([(1, 2.0, None)], "pair_id int, rmse_px double, rmse_m double"), str(tmp_path / "metrics"), {"note": "n"})
    assert json.loads(spark.read.text(str(tmp_path / "metrics")).first()["value"]) == {"rmse_px": 2.0, "note": "n"}
    pairs = spark.range(70).select(F.lit("n").alias("name"), F.when(F.col("id") < 66, "t").otherwise("u").alias("tile"), F.lit(5.0).alias("tilt_deg"), F.col("id").cast("double").alias("bx"))
    sinks.write_training_pairs(pairs, str(tmp_path / "training"))
    assert spark.read.parquet(str(tmp_path / "training/pairs")).count() == 66
    assert [r["n_correspondences"] for r in spark.read.json(str(tmp_path / "training/manifest")).collect()] == [66]


def test_usable_windows(spark):
    p = cells(spark, 12, 8, lambda r, c: 7.0 if r < 4 else (0.0 if c < 4 else float(r * c)))
    nan = p.withColumn("v", F.when((F.col("r") == 8) & (F.col("c") == 4), float("nan")).otherwise(F.col("v")))
    places = spark.createDataFrame([("a", r, c) for r in (0, 4, 8, 10) for c in (0, 4)] + [("a", 4, 4), ("b", 0, 0)], "image_id string, row int, col int")
    kept = lambda px: {(r["row"], r["col"]) for r in training.usable_windows(px, places, 4).collect()}
    assert kept(p) == {(4, 4), (8, 4)}  # not blank, padded, past the edge or of another image
    assert kept(nan) == {(4, 4)}
    assert kept(p.limit(0)) == set()


def test_places_stay_inside(spark):
    images = spark.createDataFrame([("a", 40, 16), ("b", 15, 99)], "image_id string, height int, width int")
    got = training.drawn_places(images, 50, 16).collect()
    assert len(got) == 50 and all(r["image_id"] == "a" and 0 <= r["row"] <= 24 and r["col"] == 0 for r in got)
    assert min(r["row"] for r in got) < 3 and max(r["row"] for r in got) > 21
    strips = spark.createDataFrame([("s", 100, 50, 1.0, 0.0)], "image_id string, height int, width int, slope double, intercept double")
    at = {(r["row"], r["col"]) for r in training.swath_places(strips, 2, 20, 10).collect()}
    assert at == {(r + y, c + x) for r, c in ((0, 0), (80, 30)) for y in (0, 10) for x in (0, 10)}


def test_coarse_figures(spark):
    conf = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 0.2), (1, 1, 1, 0.6), (1, 1, 2, None), (2, 0, 0, 0.5)], "pair_id int, i int, j int, conf double")
    truth = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 1, 1)], "pair_id int, i int, j int")
    rows = {r["pair_id"]: r for r in training.coarse_figures(conf, truth).collect()}
    near = [-0.25 * (1 - p) ** 2 * math.log(p) for p in (0.9, 0.6)]
    far = [-0.75 * p**2 * math.log(1 - p) for p in (0.9, 0.2)]
    assert rows[1]["precision"] == 0.5  # the tie of the first cell goes to j = 0
    assert abs(rows[1]["loss"] - sum(near) / 2 - sum(far) / 2) < 1e-12
    assert rows[2]["precision"] is None and rows[2]["loss"] is None


def test_provenance(spark):
    good = '{"checkpoint_saved": true, "baseline_real_matches": 3, "history": [{"real_matches": 1}]}'
    reports = spark.createDataFrame([("good", good), ("old", '{"history": []}'), ("cut", good[:20]), ("lost", good.replace("true", "false")), ("null", None)], "file string, json string")
    weights = reports.select("file").unionByName(spark.createDataFrame([("none",)], "file string"))
    got = {r["file"]: (r["found"], r["readable"], r["unsaved"], r["no_baseline"], r["no_guard"], r["sound"]) for r in training.provenance(weights, reports).collect()}
    assert got == {
        "good": (True, True, False, False, False, True), "old": (True, True, False, True, True, False), "lost": (True, True, True, False, False, False),
        "cut": (True, False, None, None, None, False), "null": (True, False, None, None, None, False), "none": (False, False, None, None, None, False),
    }


def test_skew_view_of_a_flat_image_is_flat(spark):
    flat = training.skew_view(cells(spark, 6, 9, lambda r, c: 2.0), 2.0, 0.0)
    rows = flat.collect()
    assert {(r["r"], r["c"]) for r in rows} == {(r, c) for r in range(6) for c in range(4)}
    assert all(abs(r["v"] - 2.0) < 1e-9 for r in rows)
    same = training.skew_view(cells(spark, 3, 4), 1.0, 0.0)
    assert {tuple(r) for r in same.select("r", "c", "v").collect()} == {(r, c, r * 10.0 + c) for r in range(3) for c in range(4)}
    turned = training.skew_view(cells(spark, 3, 4), 1.0, 90.0).where("v > 0").agg(F.max("v"), F.count("*")).first()
    assert abs(turned[0] - 23.0) < 1e-6 and turned[1] == 11


def test_probe_needs_a_crossing(spark):
    strips = spark.createDataFrame([(1, "t", 0.0, 0.4, -5.0, 5.0), (2, "t", 0.0, 4.0, 1.0, 5.0)], "product_id int, instrument string, west double, east double, south double, north double")
    assert [tuple(r) for r in catalog.probe_box(strips, 0.0).collect()] == [(1, 0.0, 0.4, -0.5, 0.5)]


def test_latitude_beyond_the_poles_is_an_error(spark):
    lat, lon = geometry.checked_latlon(F.col("id") * 80.0, F.lit(1.0))
    assert [r[0] for r in spark.range(2).select(lat).collect()] == [0.0, 80.0]
    with pytest.raises(Exception, match="latitude out of range"):
        spark.range(3).select(lat).collect()
