import pytest
from oracle import assert_same

import kindred.plans.record_queries  # noqa: F401
from kindred.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
