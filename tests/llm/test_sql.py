"""The queries that SQL can express, against DuckDB on small tables."""

import pytest

from regolith.llm import registry
from tests.compare import same


@pytest.mark.parametrize("name", registry.SQL)
def test_sql(spark, name):
    assert same(spark, registry.QUERIES[name], registry.SQL[name], "/root/testdata/sf0.001")
