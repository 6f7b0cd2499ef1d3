"""Plan shape of the registered queries: no cartesian products or
nested-loop joins, no row-at-a-time Python, filters pushed to the scan."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from meterframe.plans import contract  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_contract_plan_shape(spark, name):
    plan = _plan(contract.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_window_filter_reaches_scan(spark):
    plan = _plan(contract.queries()["p01_window"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["ts", "aggregate_hourly_kW"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tasks_of_an_expansion_follow_the_data(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meterframe.operators import partitioning
    monkeypatch.setattr(partitioning, "ROWS_PER_TASK", 1000)
    of = lambda n: spark.range(n).select(F.col("id").cast("string").alias("client_id"))
    tasks = [partitioning.spread(of(n), 100).rdd.getNumPartitions() for n in (5, 50, 500)]
    assert tasks == [1, 5, 50]
    assert partitioning.spread(of(0), 100).count() == 0
