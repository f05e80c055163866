"""Scale-space features against whole arrays and planted transforms; views against the relational recipe."""

import math

import numpy as np
from pyspark.sql import functions as F

from regolith.config import DEFAULT
from regolith.operators import blocks, features, training
from regolith.plans import cases
from tests.test_blocks import grid_of, image


def terrain(shape, seed=0, n=260):
    """Blobs of many sizes, as a function of continuous coordinates, so any view can be sampled without an image."""
    rng = np.random.default_rng(seed)
    h, w = shape
    y, x, s = rng.uniform(-20, h + 20, n), rng.uniform(-20, w + 20, n), rng.uniform(1.5, 7, n)
    a = rng.uniform(20, 60, n) * rng.choice([-1, 1], n)
    return lambda yy, xx: 128 + sum(k * np.exp(-((yy - i) ** 2 + (xx - j) ** 2) / (2 * z * z)) for k, i, j, z in zip(a, y, x, s, strict=True))


def tiled(spark, **grids):
    out = None
    for name, g in grids.items():
        df = image(spark, g, name)
        out = df if out is None else out.unionByName(df)
    return out


def brute_extrema(g, least):
    """Octave 0 by plain loops over the whole array."""
    seen = ~np.isnan(g)
    h, w = g.shape
    levels = []
    for sigma in features.deviations(0):
        half = math.ceil(4 * sigma)
        out = np.full(g.shape, np.nan)
        k = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma**2))
        for r in range(h):
            for c in range(w):
                if seen[r, c]:
                    r0, r1, c0, c1 = max(r - half, 0), min(r + half + 1, h), max(c - half, 0), min(c + half + 1, w)
                    weight = np.outer(k[r0 - r + half : r1 - r + half], k[c0 - c + half : c1 - c + half]) * seen[r0:r1, c0:c1]
                    out[r, c] = np.nansum(weight * g[r0:r1, c0:c1]) / weight.sum()
        levels.append(out)
    d = np.stack(levels[1:]) - np.stack(levels[:-1])
    found = set()
    for s in (1, 2, 3):
        for r in range(5, h - 5):
            for c in range(5, w - 5):
                if not seen[r - 5 : r + 6, c - 5 : c + 6].all():
                    continue
                near, x = np.delete(d[s - 1 : s + 2, r - 1 : r + 2, c - 1 : c + 2].ravel(), 13), d[s, r, c]
                if (x > least and x > near.max()) or (x < -least and x < near.min()):
                    found.add((s, r, c))
    return found


def test_extrema_against_whole_arrays(spark):
    g = terrain((70, 90))(*np.mgrid[:70, :90].astype(float))
    g[30:33, 40:45] = np.nan
    levels = features.pyramid(blocks.to_blocks(image(spark, g), side=32), 1, 32)
    got = {(r["level"], r["ri"], r["ci"]) for r in features.keypoints(levels, 255.0, settled=False, side=32).collect()}
    assert got == brute_extrema(g, 0.04 * 255 / 3 / 2) and len(got) > 15


def test_features_do_not_depend_on_blocks(spark):
    g = terrain((150, 170), 1)(*np.mgrid[:150, :170].astype(float))
    g[60:64, 100:120] = np.nan
    one, two = ({r["feature_id"]: r for r in features.of_blocks(blocks.to_blocks(image(spark, g), side=s), octaves=3, side=s).collect()} for s in (48, 256))
    assert one.keys() == two.keys() and len(one) > 60 and any(i >> 55 & 15 for i in one)
    for i, r in one.items():
        assert np.allclose([r["y"], r["x"], r["size"]], [two[i]["y"], two[i]["x"], two[i]["size"]]) and np.abs(np.array(r["d"]) - two[i]["d"]).max() <= 1


def test_a_blob_is_found_at_its_place_and_scale(spark):
    yy, xx = np.mgrid[:100, :120].astype(float)
    g = 100 * np.exp(-((yy - 41.3) ** 2 + (xx - 66.8) ** 2) / (2 * 4.0**2))
    levels = features.pyramid(blocks.to_blocks(image(spark, g)), 2)
    best = features.strongest(features.keypoints(levels, 255.0), 1).first()
    k = 2 ** best["octave"]
    assert abs(best["y"] * k - 41.3) < 0.15 and abs(best["x"] * k - 66.8) < 0.15 and best["response"] < 0
    assert 0.75 < best["scale"] * k / 4.0 < 1.25


def test_matches_under_a_turn_and_a_scale(spark):
    f = terrain((160, 160), 2)
    yy, xx = np.mgrid[:160, :160].astype(float)
    a = f(yy, xx)
    s, c = 1.25 * math.sin(0.6), 1.25 * math.cos(0.6)
    ux, uy = xx - 80, yy - 80
    b = f(80 - s * ux + c * uy, 80 + c * ux + s * uy)  # the cell (x, y) of b shows this place of a
    # the pair q has one side without features
    src, ref = tiled(spark, p=a, q=a), tiled(spark, p=b, q=np.full((40, 40), 7.0))
    fa, fb = (features.of_blocks(blocks.to_blocks(x), octaves=3) for x in (src, ref))
    got = features.match(fa, fb).toPandas()
    assert set(got["pair_id"]) == {"p"} and len(got) >= 25 and got["match_id"].is_unique
    ux, uy = got["xb"] - 80, got["yb"] - 80
    off = np.hypot(80 + c * ux + s * uy - got["xa"], 80 - s * ux + c * uy - got["ya"])
    assert (off < 1.5).mean() > 0.85


def test_views_are_those_of_the_recipe(spark):
    g = np.random.default_rng(5).normal(0, 1, (60, 75))
    pixels = image(spark, g)
    base = blocks.to_blocks(pixels, side=32)
    views = [(0, 1.0, 0.0), (1, 2.0, 36.0), (2, math.sqrt(2), 0.0), (3, 2 * math.sqrt(2), 127.3)]
    sizes = pixels.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    got = blocks.to_cells(features.view_blocks(base, features.placed_views(sizes, views), 0.0, 32))
    for k, tilt, phi in views:
        want = {(r["r"], r["c"]): r["v"] for r in training.skew_view(pixels, tilt, phi).collect()}
        mine = {(r["r"], r["c"]): r["v"] for r in got.where(F.col("image_id") == f"{k}:a").collect()}
        assert mine.keys() <= want.keys()
        assert max(abs(mine.get(p, 0.0) - want[p]) for p in want) < 1e-9  # a block that sees nothing of the image is not there


def test_features_of_views_lie_where_the_blob_is(spark):
    yy, xx = np.mgrid[:120, :140].astype(float)
    g = 100 * np.exp(-((yy - 55.0) ** 2 + (xx - 71.0) ** 2) / (2 * 5.0**2))
    got = features.of_views(blocks.to_blocks(image(spark, g)), octaves=3).toPandas()
    views = {i >> 59 & 31 for i in got["feature_id"].tolist()}
    assert len(features.view_table()) == 18 and len(views) >= 15 and got["feature_id"].is_unique
    assert np.median(np.hypot(got["y"] - 55.0, got["x"] - 71.0)) < 1.0 and np.hypot(got["y"] - 55.0, got["x"] - 71.0).max() < 8


def test_tilted_views_match_what_plain_features_miss(spark):
    f = terrain((150, 150), 4, 400)
    yy, xx = np.mgrid[:150, :60].astype(float)
    a, b = f(*np.mgrid[:150, :150].astype(float)), f(yy, 2.5 * xx)
    right = lambda m: int((np.hypot(2.5 * m["xb"] - m["xa"], m["yb"] - m["ya"]) < 3).sum())
    ta, tb = blocks.to_blocks(image(spark, a)), blocks.to_blocks(image(spark, b))
    plain = right(features.match(features.of_blocks(ta, octaves=2), features.of_blocks(tb, octaves=2)).toPandas())
    views = features.match(features.of_views(ta, octaves=2), features.of_views(tb, octaves=2)).toPandas()
    assert right(views) > plain and right(views) >= 10
    assert not views.round({"xa": 0, "ya": 0, "xb": 0, "yb": 0}).duplicated(["xa", "ya", "xb", "yb"]).any()


def test_no_images_no_features(spark):
    none = blocks.to_blocks(spark.createDataFrame([], "image_id string, r int, c int, v double"))
    assert features.of_blocks(none, octaves=2).count() == 0
    assert features.match(features.of_views(none, octaves=1), features.of_blocks(none, octaves=1)).count() == 0


def test_the_registered_methods_match_rolled_images(spark):
    g = terrain((128, 128), 7)(*np.mgrid[:128, :128].astype(float))
    got = cases.METHODS["features"](DEFAULT)(image(spark, g), image(spark, np.roll(g, 6, 1))).toPandas()
    whole = got[got["xa"] < 100]
    assert len(whole) >= 15 and (np.hypot(whole["xb"] - whole["xa"] - 6, whole["yb"] - whole["ya"]) < 0.3).mean() > 0.9


def test_an_image_matches_itself(spark):
    """Both sides one relation; of features at one place with several orientations one match stays."""
    g = terrain((100, 110), 8)(*np.mgrid[:100, :110].astype(float))
    found = features.of_blocks(blocks.to_blocks(image(spark, g)), octaves=2)
    got = features.match(found, found).toPandas()
    cells = {(round(r["y"]), round(r["x"])) for r in found.collect()}
    assert (got["conf"] == 1).all() and np.array_equal(got[["xa", "ya"]], got[["xb", "yb"]])
    assert {(round(y), round(x)) for y, x in zip(got["ya"], got["xa"])} == cells and len(got) == len(cells)
