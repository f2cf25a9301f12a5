"""Every catalog query against its SQL in DuckDB, over whole tables."""

import pytest

from checks import catalog, compare, oracles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(oracles.all_oracles())


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_same_rows(spark, connection, name):
    rows = catalog.all_queries()[name](spark, FOLDER)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan
    assert compare.compare(rows, connection, name) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1000
