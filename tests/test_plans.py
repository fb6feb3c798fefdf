"""Plan checks over the queries of the reference's operators (sf0.01): no
Python evaluation node and no cartesian or nested-loop join; the entry point
runs."""

import pytest

import __spark_entry__ as E

from conftest import SF001
from prefscope.plans.queries import QUERIES

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, (name, bad)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "n", "gsm8k_acc_pct", "cot_presence_pct"]
    assert {r["model"] for r in rows} == {"Base", "SFT", "DPO"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
