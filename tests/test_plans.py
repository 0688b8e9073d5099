"""Physical-plan checks over the registered queries (sf0.001).

No registered query may plan a cartesian product or a nested-loop join, and
scans must prune columns (the lineitem scan never reads every column).
"""

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
STREAMING = {"stream_ingest", "stream_relay_consume", "stream_audit"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - STREAMING))
def test_no_cartesian_or_nested_loop(spark, name):
    df = E.queries()[name](spark, SMOKE)
    plan = _plan(df)
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name


def test_lineitem_scan_is_pruned(spark):
    df = E.queries()["sku_resolution"](spark, SMOKE)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schemas = [line for line in plan.split("\n") if "ReadSchema" in line and "l_orderkey" in line]
    assert schemas, plan
    for s in schemas:
        assert "l_returnflag" not in s and "l_shipdate" not in s and "l_tax" not in s


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
