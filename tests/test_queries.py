"""Each query of the engine with SQL gives what DuckDB gives, on the smallest tables."""

import pytest
from oracle import assert_same, views

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert_same(registry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["idx", "v"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
