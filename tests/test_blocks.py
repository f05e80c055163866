"""Block rasters and what is built on them, against arrays; JSON objects at any depth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.operators import blocks, documents, evaluation, fitting, geometry, photometry


def image(spark, grid, name="a"):
    r, c = np.nonzero(~np.isnan(grid))
    return spark.createDataFrame([(name, int(i), int(j), float(grid[i, j])) for i, j in zip(r, c, strict=True)], "image_id string, r int, c int, v double")


def grid_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"]] = r["v"]
    return out


def test_blocks_hold_every_cell(spark):
    rng = np.random.default_rng(1)
    g = rng.normal(0, 1, (150, 301))
    g[rng.random(g.shape) < 0.1] = np.nan
    tiled = blocks.to_blocks(image(spark, g).repartition(7))
    assert {(r["ty"], r["tx"]) for r in tiled.collect()} == {(i, j) for i in range(2) for j in range(3)}
    assert np.array_equal(grid_of(blocks.to_cells(tiled), g.shape), g, equal_nan=True)


def test_boxes_over_borders(spark):
    g = np.arange(300.0 * 260).reshape(300, 260)
    tiled = blocks.to_blocks(image(spark, g))
    places = [(0, 0, 5, 5), (120, 120, 20, 20), (-10, 250, 30, 30), (290, -5, 40, 10), (0, 0, 300, 260), (400, 400, 5, 5), (127, 127, 2, 2), (-9, -9, 4, 4)]
    boxes = spark.createDataFrame([(f"g{k}", 0, "a", *p, b"n") for k, p in enumerate(places)] + [("x", 0, "b", 0, 0, 4, 4, b"")], blocks.BOX)

    def kernel(groups):
        for name, sides in groups:
            r0, c0, cells, note = sides[0]
            assert note == b"n"
            yield blocks.cell_batch([name], np.array([r0]), np.array([c0]), np.array([np.nansum(cells)]))

    got = {r["image_id"]: r["v"] for r in blocks.over_boxes(blocks.pieces(tiled, boxes), kernel, "image_id string, r int, c int, v double").collect()}
    want = {}
    for k, (r, c, h, w) in enumerate(places):
        part = g[max(r, 0) : max(r + h, 0), max(c, 0) : max(c + w, 0)]
        if part.size:
            want[f"g{k}"] = part.sum()
    assert got == want


def brute_shadows(dem, spacing, sun, steps):
    az = math.radians(sun.azimuth)
    dr, dc = -math.cos(az), math.sin(az)
    rise = math.hypot(dc * spacing.east, dr * spacing.north) * math.tan(math.radians(sun.elevation))
    dark = set()
    for r in range(dem.shape[0]):
        for c in range(dem.shape[1]):
            for s in range(1, steps + 1):
                i, j = round(r + dr * s), round(c + dc * s)
                if not (0 <= i < dem.shape[0] and 0 <= j < dem.shape[1]):
                    break
                if dem[i, j] > dem[r, c] + s * rise:
                    dark.add((r, c))
                    break
    return dark


@pytest.mark.parametrize(("azimuth", "elevation"), [(90.0, 20.0), (213.0, 8.0), (315.0, 45.0), (0.0, 2.0), (77.0, -3.0)])
def test_shadows_across_blocks(spark, azimuth, elevation):
    rng = np.random.default_rng(2)
    dem = rng.normal(0, 3, (140, 150)) + 60 * (rng.random((140, 150)) < 0.004)
    spacing, sun = photometry.Spacing(5.0, 6.0), photometry.Sun(azimuth, elevation)
    got = {(r["r"], r["c"]) for r in photometry.cast_shadows(image(spark, dem), spacing, sun, 60).collect()}
    assert got == brute_shadows(dem, spacing, sun, 60)


def test_warp_under_strong_perspective(spark, monkeypatch):
    rng = np.random.default_rng(3)
    g = rng.normal(0, 1, (140, 133))
    m = np.array([0.9, 0.1, 4.0, -0.15, 1.1, 9.0, 0.004, -0.0031, 1.0])
    models = spark.createDataFrame([("a", m.tolist()), ("gone", m.tolist())], "image_id string, m array<double>")
    for method in ("nearest", "bilinear", "cubic"):
        df = geometry.warp(image(spark, g), models, 150, 140, method)
        got = grid_of(df.where("image_id = 'a'"), (150, 140))
        inv = np.linalg.inv(m.reshape(3, 3))
        r, c = np.mgrid[:150, :140]
        x, y, w = np.tensordot(inv, np.stack([c, r, np.ones_like(r)]), 1)
        x, y = x / w, y / w
        want = np.zeros((150, 140))
        if method == "nearest":
            taps = [(np.rint(y), np.rint(x), 1.0)]
        else:
            span = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
            k = lambda d: geometry._tap_weights(d, method)
            taps = [(np.floor(y) + i, np.floor(x) + j, k(x - np.floor(x) - j) * k(y - np.floor(y) - i)) for i in span for j in span]
        for i, j, weight in taps:
            ok = (i >= 0) & (i < 140) & (j >= 0) & (j < 133)
            want[ok] += (np.broadcast_to(weight, i.shape)[ok]) * g[i[ok].astype(int), j[ok].astype(int)]
        fine = np.abs(x - np.rint(x)) + np.abs(y - np.rint(y)) > 1e-6
        assert not np.isnan(got).any() and np.allclose(got[fine], want[fine], atol=1e-6), method
        assert df.where("image_id = 'gone'").agg(F.count("*"), F.sum(F.abs("v"))).first()[:] == (150 * 140, 0.0)


@pytest.mark.parametrize("kind", ["similarity", "affine"])
def test_models_at_one_inlier_in_ten(spark, kind):
    rng = np.random.default_rng(6)
    rows, planted = [], {}
    for pair in range(4):
        a = rng.uniform(0, 1000, (400, 2))
        m = np.array([[1.1, -0.2], [0.2, 1.1]]) if kind == "similarity" else np.array([[1.1, -0.3], [0.15, 0.9]])
        planted[pair] = m
        b = a @ m.T + [20, -7] + rng.normal(0, 0.2, a.shape)
        b[40:] = rng.uniform(-300, 1500, (360, 2))
        rows += [(pair, i, *map(float, (*p, *q)), 1.0) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "pair_id long, match_id long, xa double, ya double, xb double, yb double, conf double")
    for r in fitting.ransac(df, kind).collect():
        m = np.array(r["m"]).reshape(3, 3)
        assert np.allclose(m[:2, :2], planted[r["pair_id"]], atol=5e-3), r


def test_a_large_pair_is_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(fitting, "BLOCK", 100)
    rng = np.random.default_rng(7)
    a = rng.uniform(0, 1000, (900, 2))
    b = a * 1.5 + [3, 4]
    b[::3] += 500
    df = spark.createDataFrame([(1, i, *map(float, (*p, *q)), 1.0) for i, (p, q) in enumerate(zip(a, b, strict=True))], "pair_id long, match_id long, xa double, ya double, xb double, yb double, conf double")
    packs, pools = fitting.packed(df)
    assert packs.count() > 5 and sum(len(r["points"]) for r in packs.collect()) == 3600 and len(pools.first()["pool"]) == 3600
    assert fitting.fit(df).where("inlier").count() == 600


def test_json_objects(spark):
    docs = [(1, '{"a": [{"PT": "x", "IID": 1, "in": {"PT": "y", "IID": "é", "NumberProducts": " 12 ", "ValidFootprints": "T"}}], "PT": 2}'), (2, "{broken"), (3, None), (4, ""), (5, "[" * 5000), (6, "3")]
    df = spark.createDataFrame(docs, "id int, json string")
    got = [(r["id"], r["path"], r["error"] is None) for r in documents.json_objects(df, "json", "PT", "IID").collect()]
    assert sorted(got, key=repr) == sorted([(1, "$.a[0]", True), (1, "$.a[0].in", True), (2, None, False), (5, None, False)], key=repr)
    assert sorted(map(tuple, evaluation.product_types(df).collect())) == [("1", "x", 0, False, False), ("é", "y", 12, True, False)]
