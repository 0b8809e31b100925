"""Every registered query against the SQL that states its result."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.compare import check, connect
from tests.conftest import SF

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def sound_plan(df):
    """No join that pairs all rows, no row-at-a-time Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, plan


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    verdict, _, rows = check(spark, con, name, queries()[name], ORACLES.get(name), SF, look=sound_plan)
    assert verdict in ("ok", "rows"), verdict
    assert rows > 0 or name in ORACLES


def test_entry(spark):
    out = entry(spark)
    assert out.columns and out.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
