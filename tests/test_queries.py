"""Every registered query equals its DuckDB SQL; the contract functions hold."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

ORACLES, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.alerts for r in rows) == 327
    assert set(ORACLES) <= set(QUERIES)


def test_no_cross_join_anywhere(spark, sf):
    """No plan holds a cartesian product or a nested-loop join."""
    for name, run in QUERIES.items():
        plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
