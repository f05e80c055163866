"""Catalogue snapshots, bands on one grid, methods over cases, and the small operators beside them, on inputs with known answers."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.config import Config
from regolith.operators import documents, evaluation, fitting, match_metrics, photometry, raster
from regolith.plans import bands, cases
from regolith.sources import catalogues, rasters, sinks

MATCH = "pair_id string, match_id long, xa double, ya double, xb double, yb double, conf double"


def answer(*products, status="OK", **more):
    found = [{"pdsid": p, "pt": "T", "Westernmost_longitude": str(w), "Easternmost_longitude": str(e), "Minimum_latitude": str(s), "Maximum_latitude": str(n)} for p, w, e, s, n in products]
    return json.dumps({"ODEResults": {"Status": status, "Products": {"Product": found[0] if len(found) == 1 else found}, **more}})


def ids(df):
    return [r["product_id"] for r in df.orderBy("product_id").collect()]


def test_answers_of_one_or_many_products(spark, tmp_path):
    (tmp_path / "1.json").write_text(answer(("a", 1, 2, 3, 4)))
    (tmp_path / "2.json").write_text(answer(("b", "x", 2, 3, 4), ("c", 0, 1, -1, 1)))
    (tmp_path / "3.json").write_text("")
    got = {r["product_id"]: (r["page"], r["west"], r["north"]) for r in catalogues.products(catalogues.read_answers(spark, str(tmp_path))).collect()}
    assert got == {"a": ("1.json", 1.0, 4.0), "b": ("2.json", None, 4.0), "c": ("2.json", 0.0, 1.0)}


@pytest.mark.parametrize("text, said", [(answer(("a", 1, 2, 3, 4), status="ERROR", Error="too many"), "p: too many"), ('{"ODEResults": ', "p: JSONDecodeError")])
def test_a_failed_answer_names_its_page(spark, text, said):
    answers = spark.createDataFrame([("p", text)], "page string, text string")
    with pytest.raises(Exception, match=said):
        catalogues.products(answers).collect()


def test_snapshots_are_made_once_and_searched_in_the_scan(spark, tmp_path):
    made = []

    def make(n=400):
        made.append(n)
        k = F.col("id")
        return spark.range(n).select(k.alias("product_id"), (k % 20 * 18.0).alias("west"), (k % 20 * 18.0 + 5).alias("east"), (F.floor(k / 20) * 8.0 - 80).alias("south"), (F.floor(k / 20) * 8.0 - 76).alias("north"))

    path = str(tmp_path / "kept")
    kept = catalogues.snapshot(spark, path, make)
    assert kept.count() == 400 and catalogues.snapshot(spark, path, make).count() == 400 and made == [400]
    near = catalogues.within(kept, 20.0, 0.0, 40.0, 9.0)
    assert ids(near) == [201, 202, 221, 222]
    plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert all(x in pushed for x in ("LessThanOrEqual(west,", "GreaterThanOrEqual(east,", "LessThanOrEqual(south,", "GreaterThanOrEqual(north,"))
    assert ids(catalogues.within(kept, 350.0, 0.0, 1.0, 1.0)) == [200]
    seen, last = [], None
    while rows := catalogues.page(near, 3, last).collect():
        seen, last = seen + [r["product_id"] for r in rows], rows[-1]["product_id"]
    assert seen == [201, 202, 221, 222]
    os.remove(f"{path}/_SUCCESS")  # as if cut off
    assert catalogues.snapshot(spark, path, lambda: make(10)).count() == 10
    assert catalogues.snapshot(spark, path, lambda: make(5), force=True).count() == 5 and made == [400, 10, 5]


def strip(spark, image_id, rows, cols, row0=0, col0=0, step=0.01):
    return spark.createDataFrame([(image_id, r, c, 10.0 + step * (c + col0), 5.0 - step * (r + row0)) for r in range(rows) for c in range(cols)], "image_id string, r int, c int, lon double, lat double")


def test_ground_that_is_not_shared(spark):
    a, b = strip(spark, "a", 5, 5), strip(spark, "b", 5, 5, 0, 50)
    assert bands.ground_of(a, b) is None and bands.ground_of(a, a.limit(0)) is None
    g = bands.ground_of(a, strip(spark, "b", 5, 5, 2, 1))
    assert (round(g.west, 6), round(g.east, 6), round(g.south, 6), round(g.north, 6)) == (10.01, 10.04, 4.96, 4.98)
    table = spark.createDataFrame([("a", 1, 900.0), ("b", 1, 900.0)], "image_id string, band int, wavelength_nm double")
    cube = lambda g: g.select("image_id", F.lit(1).alias("band"), "r", "c", F.lit(1.0).alias("v"))
    rows = bands.compare(bands.Swath(cube(a), table, a), bands.Swath(cube(b), table, b), (900.0,)).collect()
    assert [(r["mirrored"], r["registered"], r["reason"]) for r in rows] == [(False, False, "no shared ground"), (True, False, "no shared ground")]


def test_a_mirrored_band_registers_only_when_turned(spark):
    rng = np.random.default_rng(4)
    h, w = 72, 64
    grid = rng.normal(0, 1, (h, w))
    for _ in range(2):
        grid = (grid + np.roll(grid, 1, 0) + np.roll(grid, 1, 1) + np.roll(grid, (1, 1), (0, 1))) / 4
    cube = lambda name, g: spark.createDataFrame([(name, 1, r, c, float(g[r, c])) for r in range(h) for c in range(w)], "image_id string, band int, r int, c int, v double")
    stored = grid[:, ::-1].copy()
    stored[10:14, 20:24] = bands.IGNORE
    table = spark.createDataFrame([("a", 1, 1504.0), ("b", 1, 1500.0)], "image_id string, band int, wavelength_nm double")
    a = bands.Swath(cube("a", grid), table, strip(spark, "a", h, w))
    b = bands.Swath(cube("b", stored), table, strip(spark, "b", h, w), bands.IGNORE)
    rows = {r["mirrored"]: r for r in bands.compare(a, b, (1504.0,), gated=False, cfg=Config(contrast_kernel=15, min_tile_px=32)).collect()}
    turned, plain = rows[True], rows[False]
    assert turned["registered"] and turned["match_count"] > 20 and turned["inlier_ratio"] > 0.9 and turned["rmse_px"] < 0.5
    # the matcher names a best place for any patch: what is not there shows in the share of inliers
    assert not plain["registered"] or plain["inlier_ratio"] < 0.5
    assert 0.9 < turned["overlap"] < 1.0 and turned["scale_ratio"] == 1.0


def test_cases_with_a_method_that_fails_and_one_that_finds_nothing(spark):
    images = spark.createDataFrame([(i, r, c, float(r * c)) for i in ("x:1", "y") for r in range(4) for c in range(4)], "image_id string, r int, c int, v double")

    def shifted(source, reference):
        k = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")
        pts = source.select("image_id").distinct().select("image_id", k).where(~F.col("image_id").contains("y"))
        x, y = (F.col("k") * 7 % 40).cast("double"), (F.col("k") * 11 % 37).cast("double")
        return pts.select(F.col("image_id").alias("pair_id"), F.col("k").cast("long").alias("match_id"), x.alias("xa"), y.alias("ya"), (x + 2).alias("xb"), (y - 1).alias("yb"), F.lit(1.0).alias("conf"))

    def broken(source, reference):
        raise ValueError("no weights")

    got = {(r["case"], r["method"]): r for r in cases.run(images, images, 64.0, {"shifted": shifted, "broken": broken}, gated=False).collect()}
    assert set(got) == {(i, m) for i in ("x:1", "y") for m in ("shifted", "broken")}
    full, none, lost = got["x:1", "shifted"], got["y", "shifted"], got["y", "broken"]
    assert full["matches"] == 40 and full["inlier_ratio"] == 1.0 and full["rmse_px"] < 1e-6 and full["error"] is None
    assert none["matches"] == 0 and none["rmse_px"] is None and none["coverage"] == 0
    assert lost["matches"] is None and lost["error"] == "ValueError: no weights"
    alone = cases.run(images, images, 64.0, {"broken": broken}).collect()
    assert len(alone) == 2 and not any(r["gate"] for r in alone)
    found, choice = cases.match_and_select(images, images, shifted, ("similarity", "affine"))
    assert found.count() == 40 and [tuple(r)[:2] for r in choice.collect()] == [("x:1", "similarity")]


@pytest.mark.parametrize("n", [16, 17, 41])
def test_halves_differ_by_one_at_most(spark, n):
    keys = spark.range(n).select(F.lit("a").alias("pair_id"), F.col("id").alias("match_id"))
    keys = keys.withColumn("x", fitting.lcg().cast("double"))
    middle = raster.quantiles(keys, ("pair_id",), (0.5,))
    assert keys.join(middle, "pair_id").where(F.col("x") < F.element_at("p", 1)).count() == n // 2


def test_pairs_without_matches_have_no_coverage(spark):
    some = spark.createDataFrame([("a", 0, 1.0, 1.0, 1.0, 1.0, 1.0)], MATCH)
    pairs = spark.createDataFrame([("a",), ("b",), ("b",)], "pair_id string")
    got = {r["pair_id"]: (r["coverage"], r["entropy"]) for r in match_metrics.uniformity(some, 64, pairs=pairs).collect()}
    assert got == {"a": (1 / 64, 0.0), "b": (0.0, 0.0)}


def test_medians_of_match_sets(spark):
    rng = np.random.default_rng(2)
    rows = [(p, i, 0.0, 0.0, float(x), float(y), 1.0) for p, n in (("a", 9), ("b", 30), ("c", 7)) for i, (x, y) in enumerate(rng.normal(0, 3, (n, 2)))]
    got = {r["pair_id"]: r for r in match_metrics.offset_mad(spark.createDataFrame(rows, MATCH)).collect()}
    for p in "ab":
        xy = np.array([r[4:6] for r in rows if r[0] == p])
        mid = np.median(xy, axis=0)
        want = [*mid, *np.median(np.abs(xy - mid), axis=0)]
        assert np.allclose([got[p][k] for k in ("dx", "dy", "mad_x", "mad_y")], want)
    assert got["c"]["n"] == 7 and got["c"]["dx"] is None
    assert match_metrics.offset_mad(spark.createDataFrame([], MATCH)).collect() == []


def test_windows_past_the_edge(spark):
    image = spark.createDataFrame([("a", r, c, 0.0) for r in range(4) for c in range(6)], "image_id string, r int, c int, v double")
    assert raster.checked_window(image, 1, 2, 3, 4).count() == 12
    for place in ((2, 0, 3, 2), (0, 4, 2, 3), (-1, 0, 2, 2)):
        with pytest.raises(ValueError, match="pass the edge of a, 4 x 6"):
            raster.checked_window(image, *place)


@pytest.mark.parametrize("towards, east, north", [("east", np.sin(np.radians(20)), 0.0), ("north", 0.0, np.sin(np.radians(20)))])
def test_slopes_face_their_way(spark, towards, east, north):
    dem = photometry.facing_slope(spark, 5, 6, 7.4, towards)
    sun = {k: photometry.cos_incidence(dem, photometry.Spacing(7.4, 7.4), photometry.Sun(k, 45.0)).collect() for k in (0.0, 90.0)}
    for azimuth, part in ((0.0, north), (90.0, east)):
        want = np.cos(np.radians(20)) * np.sin(np.radians(45)) + part * np.cos(np.radians(45))
        assert all(abs(r[-1] - want) < 1e-9 for r in sun[azimuth])


def test_small_ones(spark, tmp_path):
    members = spark.createDataFrame([("z", 1, "a.img"), ("z", 2, "b_rfl.img"), ("y", 1, "c.img")], "archive string, position int, name string")
    assert {tuple(r) for r in rasters.first_member(members, ".img", preferred="rfl").collect()} == {("z", "b_rfl.img"), ("y", "c.img")}
    fitted = spark.createDataFrame([("a", 1.23456, 0.0, 0.0, 0.0, 1.0, 0.0, True)], "pair_id string, xa double, ya double, xb double, yb double, conf double, residual double, inlier boolean")
    assert sinks.match_points(fitted, 3).first()["source_x"] == "1.235" and sinks.match_points(fitted).first()["source_x"] == "1.2346"
    texts = spark.createDataFrame([("## A\n## B\nx ## y",), (None,), ("",)], "text string")
    assert [r["heads"] for r in documents.pattern_counts(texts, "text", heads="(?m)^## ").collect()] == [2, 0, 0]
    case = spark.createDataFrame([("k", 10, 0.5)], "case string, matches long, rmse_px double")
    assert evaluation.adoption(case, case).first()["verdict"] == "adopt"
