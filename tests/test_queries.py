"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import pytest

from regolith.plans import catalog_queries, evaluation_queries, feature_queries, match_queries, raster_queries, registration_queries, training_queries
from tests.compare import same

SF = "/root/testdata/sf0.001"
PARTS = (match_queries, raster_queries, catalog_queries, evaluation_queries, training_queries, registration_queries, feature_queries)
WITH_SQL = [(p, n) for p in PARTS for n in p.SQL]
WITHOUT = [(p, n) for p in PARTS for n in p.QUERIES if n not in p.SQL]
#: May be empty on the smallest tables.
MAYBE_EMPTY = {"containment_first", "knn_hamming"}


@pytest.mark.parametrize("part, name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_sql(spark, part, name):
    assert same(spark, part.QUERIES[name], part.SQL[name], SF) or name in MAYBE_EMPTY


@pytest.mark.parametrize("part, name", WITHOUT, ids=[n for _, n in WITHOUT])
def test_runs(spark, part, name):
    assert part.QUERIES[name](spark, SF).count() > 0


def test_gate_of_windows(spark):
    rows = registration_queries.control_gate(spark, SF).collect()
    assert rows and all(r["passed"] for r in rows)


def test_windows_hold_every_row(spark):
    rows = registration_queries.windows(spark, SF).groupBy("image_id").count().collect()
    cells = registration_queries.pixels(spark, SF)
    n = cells.agg({"r": "max"}).first()[0] + 1
    assert len(rows) == -(-n // registration_queries.WINDOW) and {r["count"] for r in rows} == {128 * 64}
    back = registration_queries.windows(spark, SF).select("c", "v").distinct()
    assert cells.select("c", "v").distinct().exceptAll(back).isEmpty()


def test_shift_of_windows_is_known(spark):
    """Every window is matched with itself rolled by three columns."""
    shifts = registration_queries.phase_shift(spark, SF).collect()
    assert len(shifts) == 4 and all(abs(r["dx"] - 3) < 0.2 and abs(r["dy"]) < 0.2 for r in shifts)
    matched = registration_queries.match_windows(spark, SF).selectExpr("pair_id", "xb - xa AS dx", "yb - ya AS dy").groupBy("pair_id").agg({"dx": "median", "dy": "median"}).collect()
    assert len(matched) == 4 and all(abs(r["median(dx)"] - 3) < 0.2 and abs(r["median(dy)"]) < 0.2 for r in matched)
    metrics = registration_queries.register_pair(spark, SF).collect()
    assert len(metrics) == 4 and all(r["kind"] == "similarity" and r["sub_pixel"] and r["inlier_ratio"] > 0.9 for r in metrics)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
