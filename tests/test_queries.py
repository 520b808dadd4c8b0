"""Every query against its SQL in DuckDB, and rows from those without."""

import pytest

from conftest import rows
from scorelake import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import os

    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
