"""Cases of the findings of round 4: rasters of many rows, ragged blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.config import Config
from regolith.operators import catalog, features, fitting, geometry, raster, training
from regolith.plans import raster_queries
from tests.compare import same


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    """A raster of 1,003 rows of 64."""
    folder = tmp_path_factory.mktemp("ragged")
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1003")
    e.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_noise_of_cells_past_64_bits(spark):
    """the generator's product of a late cell is over 2^63, its remainder is not."""
    n = 1 << 21
    cells = spark.createDataFrame([("i", n, 0, 3.0), ("i", n, 3, 5.0)], "image_id string, r int, c int, v double")
    got = {r["c"]: r["v"] for r in raster.substitute(cells, "noise").collect()}
    for c in (0, 3):
        u1, u2 = (((((n * 4 + c) * 2 + i) * 1103515245 + 12345) * 69069 + 1) % 2**31 / 2**31 for i in (1, 2))
        assert abs(got[c] - (4 + np.sqrt(-2 * np.log(max(u1, 1e-12))) * np.cos(2 * np.pi * u2))) < 1e-9


def test_inverse_of_a_long_strip(spark):
    """down a million rows lon and lat are all but a line; four degrees are still determined, and samples on a line are not."""
    rows = spark.range(0, 1_000_000, 200).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(63), F.lit(9))).alias("c"))
    g = rows.select((9.0 + 0.0025 * F.col("c") + 0.0004 * F.col("r")).alias("lon"), (12.0 - 0.0026 * F.col("r") + 0.0003 * F.col("c")).alias("lat"),
                    F.col("c").cast("double").alias("pixel"), F.col("r").cast("double").alias("scan"))
    assert geometry.fit_inverse(g, 4)["rms"] < 1e-4
    with pytest.raises(ValueError):
        geometry.fit_inverse(g.where("pixel = 0"), 1)


def test_blocks_of_a_ragged_raster(spark, ragged):
    """1,003 rows by fours; the last block has three rows."""
    got = raster_queries.decimate_area(spark, ragged)
    assert got.agg(F.max("r")).first()[0] == 250
    assert same(spark, raster_queries.decimate_area, raster_queries.SQL["decimate_area"], ragged) == 251 * 16


@pytest.fixture(scope="module")
def repeated(spark):
    """600 products, and 3,000 tiles that have ten boxes between them."""
    k = F.col("id")
    products = spark.range(600).select(k.alias("product_id"), F.lit("x").alias("instrument"), (k % 30 + 0.5).alias("west"), (k % 30 + 2.5).alias("east"), (k % 7 + 0.5).alias("south"), (k % 7 + 2.0).alias("north"))
    tiles = spark.range(3000).select(k.alias("tile_id"), (k % 10 * 3.0).alias("west"), (k % 10 * 3.0 + 3).alias("east"), F.lit(0.0).alias("south"), F.lit(3.0).alias("north"), (k % 91).alias("incidence"))
    return products.cache(), tiles.cache()


def pairs_of(products, tiles):
    return products.alias("p").join(tiles.alias("t"), F.expr("least(p.east, t.east) > greatest(p.west, t.west) AND least(p.north, t.north) > greatest(p.south, t.south)"))


def test_products_meet_boxes_once(spark, repeated):
    """F6, F8, F10: what is counted of a product's tiles is worked out from their boxes, not from pairs of product and tile."""
    products, tiles = repeated
    met = catalog._met(products, catalog._boxes(tiles, F.count("*").alias("tiles")))
    assert met.count() * 300 == pairs_of(products, tiles).count() > 0
    area = "(least(p.east, t.east) - greatest(p.west, t.west)) * (least(p.north, t.north) - greatest(p.south, t.south))"
    want = {r[0]: r[1:] for r in pairs_of(products, tiles).groupBy("product_id").agg(F.count("*"), F.round(F.sum(F.expr(area)), 6)).collect()}
    assert {r["product_id"]: (r["hits"], round(r["covered"], 6)) for r in catalog.rank_products(products, tiles).collect()} == want
    picked = {r["product_id"]: (r["hits"], r["illuminations"]) for r in catalog.pick_products(products, tiles).collect()}
    lit = {}
    for r in pairs_of(products, tiles).select("product_id", "incidence").collect():
        bins = lit.setdefault(r[0], [0] * 4)
        bins[sum(r[1] >= x for x in (30, 50, 70))] += r[1] <= 90
    assert picked == {k: (want[k][0], sum(n >= 2 for n in v)) for k, v in lit.items()}


@pytest.mark.parametrize("check_north", [True, False])
def test_first_container_of_repeated_boxes(spark, repeated, check_north):
    """strips are compared with distinct boxes."""
    products, tiles = repeated
    inside = "t.west <= p.west AND t.east >= p.east AND t.south <= p.south" + (" AND t.north >= p.north" if check_north else "")
    want = products.alias("p").join(tiles.alias("t"), F.expr(inside)).groupBy("product_id").agg(F.min("tile_id")).collect()
    got = catalog.containing_tile(products, tiles, check_north)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want} and want
    assert "boxes-" in str(got.inputFiles())


def test_overlap_in_lists(spark, repeated, monkeypatch):
    """every pair comes, whatever number of lists the tiles of a box lie in."""
    products, tiles = repeated
    monkeypatch.setattr(catalog, "LIST", 64)
    got = catalog.overlap(products, tiles, digits=6)
    assert "lists-" in str(got.inputFiles())
    assert got.select("product_id", "tile_id").exceptAll(pairs_of(products, tiles).select("product_id", "tile_id")).isEmpty()
    assert got.count() == pairs_of(products, tiles).count()


@pytest.mark.parametrize("kind", ["similarity", "affine", "homography"])
def test_gathered_pairs_and_spread_pairs_agree(spark, monkeypatch, kind):
    """a pair that its task has whole gets the model that blocks and pools give it, without tables of these."""
    rng = np.random.default_rng(11)
    rows = []
    for pair, n in (("a", 60), ("b", 300), ("c", 3), ("d", 1)):
        x = rng.uniform(0, 512, (n, 2))
        y = x @ np.array([[1.02, 0.03], [-0.03, 1.02]]) + (21.5, -4.25) + rng.normal(0, 0.3, (n, 2))
        y[: n // 3] += rng.uniform(20, 90, (n // 3, 2))
        rows += [(pair, i * 7919 + 2**34, *map(float, (*x[i], *y[i]))) for i in range(n)]
    ms = spark.createDataFrame(rows, "pair_id string, match_id long, xa double, ya double, xb double, yb double").cache()
    tags = []
    monkeypatch.setattr(fitting, "written", lambda df, tag, f=fitting.written: (tags.append(tag), f(df, tag))[1])
    got = {r["pair_id"]: r["m"] for r in fitting.ransac(ms, kind).collect()}
    assert "packs" not in tags and "pools" not in tags
    monkeypatch.setattr(fitting, "ransac", None)
    want = {r["pair_id"]: r["m"] for r in fitting._ransac(ms, *fitting.packed(ms), kind, Config()).collect()}
    assert got.keys() == want.keys() and {"a", "b"} <= set(got)
    assert all(np.allclose(got[k], want[k], rtol=1e-7, atol=1e-7) for k in want)


def test_view_of_a_long_strip_is_worked_out_where_it_lies(spark, monkeypatch):
    """of the bounding box of a turned strip only the blocks that see it are worked out; all cells come."""
    cells = spark.range(3000 * 8).select(F.lit("s").alias("image_id"), F.floor(F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"), F.lit(2.0).alias("v"))
    found = []
    monkeypatch.setattr(training, "written", lambda df, tag, f=training.written: (found.append((tag, out := f(df, tag))), out)[1])
    view = training.skew_view(cells, 2.0, 36.0)
    got = view.agg(F.count("*").alias("n"), F.count_distinct("r", "c").alias("places"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), F.count_if(F.col("v") != 0).alias("lit")).first()
    assert got["n"] == got["places"] == got["h"] * got["w"] and 0 < got["lit"] < got["n"] / 50
    blocks_in_all = -(-got["h"] // 128) * -(-got["w"] // 128)
    assert 0 < dict(found)["view_blocks"].count() < blocks_in_all / 2


def test_boxes_are_trimmed_to_their_data():
    """a blur, and with it the blobs, is the same without the cells around that have no data."""
    box = np.full((194, 194), np.nan)
    box[40:104, 33:65] = np.random.default_rng(3).normal(0, 1, (64, 32))
    top, left, part = features._trimmed(box)
    assert (top, left, part.shape) == (40, 33, (64, 32))
    for s in features.deviations(0):
        assert np.array_equal(features.blurred(box, s)[40:104, 33:65], features.blurred(part, s))
    assert features._trimmed(np.full((5, 5), np.nan))[2].size == 0
