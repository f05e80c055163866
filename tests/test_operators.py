"""Properties of the registration operators on generated inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.config import Config
from regolith.functions.tables import written
from regolith.operators import catalog, fitting, geometry, match_metrics, matching, photometry, raster
from regolith.plans import registration
from regolith.sources import rasters, sinks


def match_set(spark, pa, pb, pair="p"):
    rows = [(pair, i, *map(float, a), *map(float, b), 1.0) for i, (a, b) in enumerate(zip(pa, pb, strict=True))]
    return spark.createDataFrame(rows, "pair_id string, match_id long, xa double, ya double, xb double, yb double, conf double")


def image(spark, grid, name="i"):
    rows = [(name, int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(grid, float))]
    return spark.createDataFrame(rows, "image_id string, r int, c int, v double")


def grid_of(df, column="v"):
    rows = df.select("r", "c", column).collect()
    out = np.full((max(r["r"] for r in rows) + 1, max(r["c"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["r"], r["c"]] = np.nan if r[column] is None else r[column]
    return out


def transform(m, p):
    q = np.c_[p, np.ones(len(p))] @ np.asarray(m).T
    return q[:, :2] / q[:, 2:]


def test_uniformity(spark):
    cluster, spread = [(10, 10)] * 64, [(x, y) for x in range(5, 256, 32) for y in range(5, 256, 32)]
    one = match_metrics.uniformity(match_set(spark, cluster, cluster), 256).first()
    all_ = match_metrics.uniformity(match_set(spark, spread, spread), 256).first()
    assert one["coverage"] == 1 / 64 and abs(one["entropy"]) < 1e-12
    assert all_["coverage"] == 1.0 and abs(all_["entropy"] - 1) < 1e-12
    assert match_metrics.coverage_grid(match_set(spark, cluster, cluster), 256).count() == 64


def test_offsets(spark):
    rng = np.random.default_rng(0)
    pa = rng.uniform(0, 500, (40, 2))
    pb = pa + [3, -2]
    pb[:5] += 500
    r = match_metrics.offset_mad(match_set(spark, pa, pb)).first()
    assert abs(r["dx"] - 3) < 1e-9 and abs(r["dy"] + 2) < 1e-9
    few = match_metrics.offset_mad(match_set(spark, pa[:7], pb[:7])).first()
    assert few["n"] == 7 and few["dx"] is None
    c = match_metrics.coarse_offset(match_set(spark, pa[:7], pb[:7])).first()
    assert (c["dx"], c["dy"], c["n"]) == (0, 0, 7)


def test_summary_guards(spark):
    pa = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    ms = match_set(spark, pa, [(x + 3, y - 2) for x, y in pa]).withColumn("residual", F.lit(0.0)).withColumn("inlier", F.col("match_id") < 2)
    r = match_metrics.summarise(ms, 512, 4, 7.403, 0.26).first()
    assert r["inlier_count"] == 2 and r["rmse_px"] == 0 and r["rmse_px_guarded"] is None and r["sub_pixel"] is False
    r = match_metrics.summarise(ms.withColumn("inlier", F.lit(True)).withColumn("residual", F.lit(0.513)), 512, 4, 7.403, 0.26).first()
    assert r["sub_pixel"] and not r["sub_pixel_source"] and abs(r["rmse_source_px"] - 0.513 * 7.403 / 0.26) < 1e-9
    plain = sinks.metrics_json(match_metrics.summarise(ms, 512), {"note": "x"}).first()["json"]
    assert "rmse_m" not in plain and '"note":"x"' in plain


MODELS = {
    "similarity": [[1.05 * math.cos(math.radians(7)), -1.05 * math.sin(math.radians(7)), 12], [1.05 * math.sin(math.radians(7)), 1.05 * math.cos(math.radians(7)), -5], [0, 0, 1]],
    "affine": [[1.03, 0.08, 4], [-0.02, 0.97, 9], [0, 0, 1]],
    "homography": [[1.02, 0.01, 5], [-0.01, 0.98, 3], [1e-5, 2e-5, 1]],
}


@pytest.mark.parametrize("kind", MODELS)
def test_known_models(spark, kind):
    pa = np.random.default_rng(1).uniform(0, 500, (80, 2))
    pb = transform(MODELS[kind], pa)
    pb[:10] += 60
    fitted = fitting.fit(match_set(spark, pa, pb), kind)
    r = fitting.guarded_rmse(fitted, kind).first()
    assert r["n_inliers"] >= 70 and r["rmse"] < 0.05
    m = np.array(fitting.ransac(match_set(spark, pa, pb), kind).first()["m"]).reshape(3, 3)
    assert np.allclose(transform(m, pa[10:]), pb[10:], atol=1e-3)


@pytest.mark.parametrize("kind", MODELS)
def test_models_under_many_outliers(spark, kind):
    """At three inliers in ten the planted model is found in every one of 60 pairs."""
    rng, sets = np.random.default_rng(11), None
    rows = []
    for pair in range(60):
        pa = rng.uniform(0, 500, (120, 2))
        pb = transform(MODELS[kind], pa) + rng.normal(0, 0.2, pa.shape)
        pb[rng.permutation(120)[36:]] = rng.uniform(0, 500, (84, 2))
        rows += [(f"p{pair}", i, *map(float, a), *map(float, b), 1.0) for i, (a, b) in enumerate(zip(pa, pb, strict=True))]
    sets = spark.createDataFrame(rows, "pair_id string, match_id long, xa double, ya double, xb double, yb double, conf double")
    at = np.array([[100.0, 100.0], [400.0, 100.0], [250.0, 400.0]])
    models = fitting.ransac(sets, kind).collect()
    good = sum(np.abs(transform(np.array(r["m"]).reshape(3, 3), at) - transform(MODELS[kind], at)).max() < 2 for r in models)
    assert good == 60


def test_selection(spark):
    rng = np.random.default_rng(2)
    pa = rng.uniform(0, 500, (120, 2))
    a = math.radians(4)
    sim = np.array([[1.02 * math.cos(a), -1.02 * math.sin(a), 6], [1.02 * math.sin(a), 1.02 * math.cos(a), -3], [0, 0, 1]])
    noise = rng.normal(0, 0.3, pa.shape)
    both = match_set(spark, pa, transform(sim, pa) + noise, "sim").unionByName(match_set(spark, pa, transform([[1, 0.25, 6], [0, 1, -3], [0, 0, 1]], pa) + noise, "shear"))
    both = both.unionByName(match_set(spark, pa[:15], pa[:15], "few"))
    got = {r["pair_id"]: r["best"] for r in fitting.select_model(both).collect()}
    assert got["sim"] == "similarity" and got["shear"] in ("affine", "homography") and "few" not in got


def test_decompose(spark):
    df = spark.createDataFrame([("p", [0.0, -2.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "pair_id string, m array<double>")
    r = match_metrics.decompose(df).first()
    assert abs(r["scale_x"] - 2) < 1e-12 and abs(r["rotation_deg"] - 90) < 1e-9 and abs(r["anisotropy"] - 1) < 1e-12


def test_contrast_removes_a_ramp(spark):
    rng = np.random.default_rng(3)
    flat = rng.normal(128, 20, (96, 96))
    a, b = (grid_of(raster.local_contrast(image(spark, x)), "u") for x in (flat, flat + np.linspace(0, 75, 96)[None]))
    assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.9
    assert (grid_of(raster.stretch8(image(spark, np.full((8, 8), np.nan))), "u") == 0).all()


def test_box_mean_mirrors(spark):
    x = np.arange(30.0).reshape(5, 6) ** 1.5
    p = np.pad(x, 1, mode="reflect")
    want = sum(p[i : i + 5, j : j + 6] for i in range(3) for j in range(3)) / 9
    assert np.allclose(grid_of(raster.box_mean(image(spark, x), 3), "mean_v"), want)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(0, 1, 5000), "b": np.repeat([1.0, 2.0, 5.0], [3, 900, 1]), "c": np.array([7.0]), "d": np.full(50, -3.0), "e": np.exp(rng.normal(0, 9, 3000)), "f": rng.integers(0, 9, 400).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("z", None)], "image_id string, x double")
    got = {r["image_id"]: r["p"] for r in raster.quantiles(df, ("image_id",), (0.01, 0.5, 0.99)).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert np.allclose(got[k], np.quantile(x, [0.01, 0.5, 0.99]), rtol=1e-12, atol=0), k


def test_small_images_raise(spark):
    with pytest.raises(Exception, match="too small for a box"):
        raster.box_mean(image(spark, np.ones((9, 2))), 7).collect()


def test_resampling(spark):
    x = np.random.default_rng(4).normal(100, 30, (64, 48))
    d = grid_of(raster.decimate(image(spark, x), 4))
    assert d.shape == (16, 12) and np.allclose(d, x.reshape(16, 4, 12, 4).mean((1, 3)))
    f = grid_of(raster.resample_area(image(spark, x), 1.466))
    assert f.shape == (44, 33) and abs(f.mean() - x.mean()) < 0.5 and f.std() < x.std()
    ragged = grid_of(raster.decimate(image(spark, x[:63, :]), 4))
    assert ragged.shape == (15, 12)
    src, ref, k = raster.to_common_gsd(image(spark, x), image(spark, x), 5.05, 7.403)
    assert abs(k - 1.46594) < 1e-4 and grid_of(src).shape == (44, 33) and grid_of(ref).shape == (64, 48)
    assert raster.to_common_gsd(image(spark, x), image(spark, x), 5.0, 5.0)[2] == 1.0 and raster.to_common_gsd(1, 2, None, 3.0)[2] == 1.0
    assert np.allclose(grid_of(raster.decimate(raster.upsample_nearest(image(spark, x[:8, :8]), 2), 2)), x[:8, :8])


def test_roll_and_masks(spark):
    x = np.arange(12.0).reshape(3, 4)
    assert (grid_of(raster.roll(image(spark, x), 1, 3)) == np.roll(x, (1, 3), (0, 1))).all()
    fine = image(spark, np.ones((4, 4))).select("image_id", "r", "c", ((F.col("r") < 2) | (F.col("c") < 1)).alias("valid"))
    assert {(r["r"], r["c"]): r["valid"] for r in raster.majority_mask(fine, 2).collect()} == {(0, 0): True, (0, 1): True, (1, 0): False, (1, 1): False}
    n = raster.substitute(image(spark, np.random.default_rng(0).normal(5, 2, (60, 60))), "noise").agg(F.avg("v"), F.stddev_pop("v")).first()
    assert abs(n[0] - 5) < 0.3 and abs(n[1] - 2) < 0.3


def test_two_images_stay_apart(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(5, 1, (12, 12)), rng.normal(50, 1, (12, 12))
    both = image(spark, x, "x").unionAll(image(spark, y, "y"))
    ident = spark.createDataFrame([(k, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for k in "xy"], "image_id string, m array<double>")
    results = {
        "warp": geometry.warp(both, ident, 12, 12, "bilinear"), "board": raster.checkerboard(both, both), "shade": raster.divide_shading(both, both.withColumn("v", F.lit(2.0))),
    }
    for name, df in results.items():
        for k, want in (("x", x), ("y", y)):
            own = df.where(F.col("image_id") == k)
            assert own.count() == 144 and np.allclose(grid_of(own), want / 2 if name == "shade" else want), name
    masks = both.select("image_id", "r", "c", (F.col("v") < 20).alias("valid"))
    got = raster.intersect_masks(masks, raster.majority_mask(masks, 2), 2)
    assert got.count() == 288 and got.where("valid").select("image_id").distinct().collect()[0][0] == "x" and got.where("valid").count() == 144
    sweep = photometry.azimuth_sweep(photometry.cos_incidence(both, photometry.Spacing(10.0, 10.0), photometry.Sun(135.0, 20.0)).withColumn("v", F.col("mu0")), both, photometry.Spacing(10.0, 10.0), 20.0)
    assert {(r["image_id"], r["azimuth"]) for r in sweep.collect()} == {("x", 135), ("y", 135)}


def test_photometry(spark):
    flat = photometry.Spacing.at(10.0, 0.0)
    tilt = math.tan(math.radians(20)) * 10
    east = image(spark, -np.arange(32.0)[None] * tilt * np.ones((32, 1)))
    at = lambda az: photometry.cos_incidence(east, flat, photometry.Sun(az, 30.0)).agg(F.avg("mu0")).first()[0]
    assert abs(at(90.0) - math.cos(math.radians(40))) < 1e-9 and at(270.0) < at(90.0)
    north = image(spark, np.arange(32.0)[:, None] * tilt * np.ones((1, 32)))
    mu = photometry.cos_incidence(north, flat, photometry.Sun(0.0, 30.0)).agg(F.avg("mu0")).first()[0]
    assert abs(mu - math.cos(math.radians(40))) < 1e-9
    step = np.zeros((32, 64))
    step[:, 40:] = 300
    dark = {(r["r"], r["c"]) for r in photometry.cast_shadows(image(spark, step), photometry.Spacing(10.0, 10.0), photometry.Sun(90.0, 45.0)).collect()}
    assert (5, 39) in dark and (5, 41) not in dark and (5, 5) not in dark
    lit = grid_of(photometry.render(image(spark, np.zeros((8, 8))), photometry.Spacing.at(10.0, 0.0), photometry.Sun(90.0, 90.0)))
    assert np.allclose(lit, 1.0)
    best = photometry.azimuth_sweep(photometry.cos_incidence(image(spark, np.random.default_rng(5).normal(0, 5, (24, 24))), photometry.Spacing(10.0, 10.0), photometry.Sun(135.0, 20.0)).withColumn("v", F.col("mu0")), image(spark, np.random.default_rng(5).normal(0, 5, (24, 24))), photometry.Spacing(10.0, 10.0), 20.0).first()
    assert best["azimuth"] == 135 and best["corr"] > 0.999


def test_geometry(spark):
    one = spark.range(1)
    deg = one.select(geometry.arc_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first()["d"]
    assert abs(deg - math.pi * 1737400 / 180) < 1e-6
    size = lambda a, ident, crs, geo: one.select(geometry.pixel_size_m(F.lit(a), F.lit(ident), F.lit(crs), F.lit(geo)).alias("m")).first()["m"]
    assert abs(size(0.00024413536, False, "moon", True) - 7.403) < 1e-3 and size(5.05, False, "m", False) == 5.05
    assert size(1.0, True, "m", False) is None and size(1.0, False, None, False) is None
    with pytest.raises(Exception, match="positive"):
        one.select(geometry.scale_ratio(F.lit(0.0), F.lit(2.0))).collect()
    h = geometry.perspective_homography(512, 58.9, 0.3)
    corners = transform(h, np.array([[0, 0], [512, 0], [512, 512], [0, 512]], float))
    area = abs(sum(corners[i][0] * corners[i - 1][1] - corners[i - 1][0] * corners[i][1] for i in range(4))) / 2 / 512**2
    assert abs(area - math.cos(math.radians(58.9))) < 0.05
    assert np.allclose(geometry.perspective_homography(512, 0.0, 1.0), np.eye(3), atol=1e-9)


def test_inverse_and_projection(spark):
    rows = [("s", r, c, 9 + 0.002 * c + 1e-6 * r * c, 12 - 0.003 * r, float(c), float(r), float(r * 16 + c)) for r in range(16) for c in range(16)]
    g = spark.createDataFrame(rows, "image_id string, r int, c int, lon double, lat double, pixel double, scan double, v double")
    worse, model = geometry.fit_inverse(g, 1), geometry.fit_inverse(g, 2)
    assert model["rms"] < 0.05 and model["rms"] < worse["rms"]
    p = geometry.project(g.select("image_id", "r", "c", "v"), {"s": model}, g.select("r", "c", "lon", "lat"))
    assert np.allclose(grid_of(p), np.arange(256).reshape(16, 16))
    far = geometry.project(g.select("image_id", "r", "c", "v"), {"s": model}, g.select("r", "c", (F.col("lon") + 5).alias("lon"), "lat"))
    assert far.where("valid").count() == 0 and far.agg(F.sum("v")).first()[0] == 0
    two = g.select("image_id", "r", "c", "v").unionAll(g.select(F.lit("t"), "r", "c", F.col("v") + 1000))
    both = geometry.project(two, {"s": model, "t": model}, g.select("r", "c", "lon", "lat"))
    assert both.count() == 512 and np.allclose(grid_of(both.where("image_id = 't'")), np.arange(256).reshape(16, 16) + 1000)
    for bad in (g.where("r = 0"), g.limit(0), g.where("r = 3 AND c < 2")):
        with pytest.raises(ValueError):
            geometry.fit_inverse(bad, 1)


def test_warp(spark):
    x = np.random.default_rng(6).normal(0, 1, (20, 20))
    shift = spark.createDataFrame([("i", [1.0, 0.0, 3.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0])], "image_id string, m array<double>")
    for method in ("nearest", "bilinear", "cubic"):
        w = grid_of(geometry.warp(image(spark, x), shift, 20, 20, method))
        assert np.allclose(w[:18, 3:], x[2:, :17]) and (w[:, :2] == 0).all()


def test_lattices(spark):
    ident = spark.range(64).select(F.col("id").alias("i"), F.array(*map(F.lit, [1.0, 0, 0, 0, 1, 0, 0, 0, 1])).cast("array<double>").alias("m"))
    assert all(r["i"] == r["j"] for r in geometry.coarse_assignment(ident, 64).collect())
    pts = geometry.lattice(spark, 64, 8, 4.0).withColumn("m", F.array(*map(F.lit, [1.0, 0.0, 60.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])))
    assert pts.count() == 64 and geometry.correspondences(pts, 64).count() == 0


def test_catalogue(spark):
    recs = spark.createDataFrame([(1, "10", "359", "10", "1", "-5", "359", "-5", "1"), (2, "95", "1", "95", "2", "0", "1", "0", "2"), (3, "x", "1", "", "2", "y", "1", "3", "2"), (4, "1", "10", "1", "12", "-1", "10", "-1", "12")],
                                 "product_id int, UL_LAT string, UL_LON string, UR_LAT string, UR_LON string, BL_LAT string, BL_LON string, BR_LAT string, BR_LON string")
    got = {r["product_id"]: r["west"] for r in catalog.bbox(recs).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 10.0}
    label = spark.createDataFrame([('A = "x"\nB = 1\nA = 2\nC = d = e\nEND\n',)], "t string").select(catalog.parse_label(F.col("t")).alias("p")).first()["p"]
    assert [(x["key"], x["value"]) for x in label] == [("A", "x"), ("B", "1"), ("C", "d = e")]
    rep = spark.createDataFrame([("a", "real pair", True), ("a", "noise", True), ("b", "real pair", False), ("c", "real pair", True), ("c", "noise", False)], "file string, name string, passed boolean")
    verdicts = {r["file"]: r["verdict"] for r in catalog.gate_audit(rep, ("real pair", "noise")).collect()}
    assert verdicts == {"a": "passed", "b": "failed", "c": "failed"}
    assert catalog.gate_audit(rep.where("file = 'a'"), ("real pair", "noise", "constant")).first()["verdict"] == "malformed"


def test_overlap_of_wide_boxes(spark):
    rng = np.random.default_rng(7)
    box = lambda n, s: [(i, "x", float(w), float(w + a), float(b), float(b + c)) for i, (w, b, a, c) in enumerate(zip(rng.uniform(0, 60, n), rng.uniform(-30, 30, n), rng.uniform(0, s, n), rng.uniform(0, s, n), strict=True))]
    a, b = box(60, 20), box(40, 9)
    got = {(r["product_id"], r["tile_id"]): r["area"] for r in catalog.overlap(spark.createDataFrame(a, "product_id int, instrument string, west double, east double, south double, north double"), spark.createDataFrame(b, "tile_id int, instrument string, west double, east double, south double, north double")).collect()}
    want = {(p[0], q[0]): (min(p[3], q[3]) - max(p[2], q[2])) * (min(p[5], q[5]) - max(p[4], q[4])) for p in a for q in b if min(p[3], q[3]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[4], q[4])}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 16)
    rng = np.random.default_rng(8)
    t = rng.normal(0, 1, (50, 8))
    q = t[:10] + rng.normal(0, 0.01, (10, 8))
    a = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid int, d array<double>")
    b = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(t)], "tid int, d array<double>")
    assert {(r["qid"], r["tid"]) for r in matching.knn_ratio(a, b, 0.5).collect()} == {(i, i) for i in range(10)}


def test_tile_plan(spark):
    sizes = spark.createDataFrame([("a", 512, 512), ("b", 100, 3000), ("c", 20, 20)], "image_id string, height int, width int")
    t = matching.tile_plan(sizes).collect()
    a = [x for x in t if x["image_id"] == "a"]
    assert len(a) == 16 and all(x["h"] % 8 == 0 and x["rh"] % 8 == 0 and x["rh"] >= x["h"] for x in a)
    assert sum(x["image_id"] == "b" for x in t) == 1 and not any(x["image_id"] == "c" for x in t)


def test_phase_shift_sign():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (64, 64))
    dx, dy, response = matching.phase_shift(x, np.roll(x, (2, 5), (0, 1)))
    assert abs(dx - 5) < 0.2 and abs(dy - 2) < 0.2 and response > 0.1


CFG = Config(contrast_kernel=15, refine_patch=16)


def textured(spark, name="p", shift=0, seed=10):
    x = np.random.default_rng(seed).normal(100, 20, (96, 96))
    return image(spark, np.roll(x, shift, 1), name)


def test_registration_and_refinement(spark, tmp_path):
    match = registration.default_match(cfg=CFG)
    r = registration.register(textured(spark), textured(spark, shift=4), 96.0, 7.0, 7.0, 3.5, match, cfg=CFG)
    m = r.metrics.first()
    assert m["kind"] == "similarity" and m["inlier_ratio"] > 0.7 and m["sub_pixel"]
    paths = registration.deliver(r, textured(spark), 96, 96, str(tmp_path), {"site": "x"})
    out = grid_of(spark.read.parquet(paths["raster"]))
    want = grid_of(textured(spark, shift=4))
    assert np.corrcoef(out[8:-8, 12:-12].ravel(), want[8:-8, 12:-12].ravel())[0, 1] > 0.98
    assert spark.read.csv(paths["points"], header=True).count() == r.matches.count() and '"site":"x"' in spark.read.text(paths["metrics"]).first()[0]
    model = np.array(r.models.first()["m"]).reshape(3, 3)
    assert abs(model[0, 2] - 4) < 0.5 and abs(model[1, 2]) < 0.5
    a, b = (raster.local_contrast(textured(spark, shift=s), 15).select("image_id", "r", "c", "u") for s in (0, 4))
    fine = matching.refine(written(matching.match_tiles(a, b, cfg=CFG), "matches"), a, b, CFG).select((F.col("xb") - F.col("xa")).alias("dx"))
    assert fine.count() > 5 and abs(fine.agg(F.median("dx")).first()[0] - 4) < 0.3


def test_gate_passes_terrain_and_rejects_a_blind_matcher(spark):
    src, ref = textured(spark), textured(spark, shift=4)
    gate = registration.control_gate(src, ref, registration.default_match(cfg=CFG), CFG)
    assert registration.verdict(gate).first()["passed"] and registration.report(gate).where("line LIKE '%: holds with % matches%'").count() == 4

    def blind(a, b):
        return a.select(F.col("image_id").alias("pair_id")).distinct().select(
            "pair_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("match_id")
        ).select("pair_id", "match_id", *(F.col("match_id").cast("double").alias(c) for c in ("xa", "ya")), (F.col("match_id") + 3.0).alias("xb"), (F.col("match_id") - 1.0).alias("yb"), F.lit(1.0).alias("conf"))

    failed = {r["name"] for r in registration.control_gate(src, ref, blind, CFG).where("not passed").collect()}
    assert failed == {"roll +15 raw", "noise", "constant"}
    none = registration.control_gate(src, ref, lambda a, b: blind(a, b).where("match_id < 3"), CFG)
    assert [(r["name"], r["passed"]) for r in none.collect()] == [("real pair", False)] and not registration.verdict(none).first()["passed"]


def test_sources_and_sinks(spark, tmp_path):
    x = np.arange(100.0).reshape(10, 10)
    sinks.write_raster(image(spark, x), str(tmp_path / "raster"))
    w = rasters.read_window(spark, str(tmp_path / "raster"), "i", 2, 3, 4, 5)
    assert (grid_of(w) == x[2:6, 3:8]).all()
    (tmp_path / "geo.csv").write_text("Longitude,Latitude,Pixel,Scan\n9.5,12.25,1,2\n")
    assert tuple(rasters.read_geolocation(spark, str(tmp_path / "geo.csv")).first()) == (9.5, 12.25, 1.0, 2.0)
    (tmp_path / "cases.json").write_text('{"note": "n", "site_a": {"gsd_m": "7.4"}, "site_b": {"gsd_m": "0.26"}}')
    cases = {r["case"]: r["attributes"] for r in rasters.sample_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert cases == {"site_a": {"gsd_m": "7.4"}, "site_b": {"gsd_m": "0.26"}}
    ms = match_set(spark, [(1, 2)] * 300, [(3, 4)] * 300)
    assert 100 <= sinks.even_sample(ms).count() <= 120
    row = sinks.match_points(ms.withColumn("residual", F.lit(0.5)).withColumn("inlier", F.lit(True))).first()
    assert (row["source_x"], row["residual_px"], row["inlier"]) == ("1.0000", "0.5000", 1)
