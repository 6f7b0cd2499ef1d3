"""Work that must follow the rows, not the bytes or the number of folders."""
import json

import pytest
from conftest import readings
from meterframe.forecast import jobs
from meterframe.operators import evaluate, partitioning
from meterframe.sources import readers, sinks
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def panel(spark):
    return readings(spark, [(f"S{i}", f"2011-01-0{1 + h // 24} {h % 24:02d}:00", float(h % 5)) for i in range(6) for h in range(48)])


def test_series_are_dealt_out_by_rows(spark, panel, monkeypatch):
    """Small or well compressed partitions are not merged into one task."""
    monkeypatch.setattr(partitioning, "ROWS_PER_TASK", 48)
    got = jobs.recent(panel, 24)
    assert got.rdd.getNumPartitions() == 6 and got.count() == 6 * 24
    assert _plan(jobs.fit(got, "ets")).count("Exchange hashpartitioning") == 1


def test_generated_forecasts_are_never_broadcast(spark, panel):
    """The planner takes forecasts for as small as the table they come from."""
    table = jobs.fit(panel.where("hour(ts) < 12"), "ets")
    table.write.mode("overwrite").format("noop").save()
    preds = jobs.forecast(sinks.stored(table, "t"), "ets", hours=12).drop("model")
    assert "Broadcast" in _plan(evaluate.scored(panel, preds))
    pairs = evaluate.scored(panel, preds, generated=True)
    assert "Broadcast" not in _plan(pairs)
    assert sorted(pairs.collect()) == sorted(evaluate.scored(panel, preds).collect()) and pairs.count() > 0
    wanted = panel.where("hour(ts) >= 12").select("client_id", "ts")
    assert "Broadcast" not in _plan(jobs.forecast_at(sinks.stored(table, "t"), "ets", wanted))


def test_a_block_is_in_one_file(spark, tmp_path):
    rows = readings(spark, [(f"S{i:03d}", f"2011-01-01 {h:02d}:00", float(h)) for i in range(64) for h in range(24)]).repartition(8)
    clients = rows.select("client_id").distinct()
    sinks.write_master_blocks(rows, clients, str(tmp_path / "b"), block_size=4)
    values = spark.read.parquet(str(tmp_path / "b" / "values"))
    per_block = values.select("block", F.input_file_name().alias("file")).groupBy("block") \
        .agg(F.count_distinct("file").alias("files")).collect()
    assert len(per_block) == 16 and all(r["files"] == 1 for r in per_block)
    assert len(list((tmp_path / "b" / "values").glob("**/*.parquet"))) < 16
    back = readers.read_master_blocks(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_metadata_entries_are_read_line_by_line(spark, tmp_path):
    first = {"a": "2011", 'b"x': None, "ü\\": "x, ", "z": "", "c\n,": "a: b", 'd": "e': "f"}
    path = str(tmp_path / "meta.json")
    sinks.write_metadata(spark, {"k": 1, "active": None, "first": None}, path, {
        "active": spark.createDataFrame([(i,) for i in first], "client_id string"),
        "first": spark.createDataFrame(list(first.items()), "client_id string, f string")})
    assert json.loads(sinks.read_text_file(spark, path))["first"] == first
    got = readers.read_metadata_entries(spark, path)
    assert {r["name"]: r["value"] for r in got.where("keyed").collect()} == first
    assert sorted(r["name"] for r in got.where("not keyed").collect()) == sorted(first)


def test_additive_sums_in_short_aggregates(spark, panel):
    """One aggregate of all products of the columns is too long to be compiled."""
    from meterframe.forecast import additive
    plan = additive.fit(panel)._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("sum(") for line in plan.splitlines()) < 40
