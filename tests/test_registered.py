"""Every registered query against its SQL, and the shape of its plan."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
from gridledger import queries as registered
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registered.all_queries()) == set(registered.all_oracles())
    assert set(registered.all_queries()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "coverage" in df.columns


@pytest.mark.parametrize("name", sorted(registered.all_queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, con, entry.oracle_sql()[name]) is None
