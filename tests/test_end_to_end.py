"""The preprocessing job on the driver's events table written as a wide text
file: its active / dropped lists equal the DuckDB-checked contract query."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterframe.config import PreprocessConfig
from meterframe.operators import panel
from meterframe.plans import contract
from meterframe.plans.preprocess import run_preprocess
from meterframe.sources import sinks
from meterframe.sources.readers import read_master_wide
from meterframe.sources.sinks import read_text_file

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_preprocess_job_matches_contract(spark, tmp_path):
    r = contract.e_readings(spark, SF)
    # every reading as one wide row keyed by its exact timestamp, decimal comma
    names = sorted(x[0] for x in r.select("client_id").distinct().collect())
    wide = (r.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"))
            .pivot("client_id", names).agg(F.first(F.regexp_replace(F.col("y").cast("string"), r"\.", ","))))
    text = tmp_path / "wide"
    wide.select("stamp", *[F.col(f"`{c}`") for c in names]).coalesce(1) \
        .write.option("header", True).option("sep", ";").csv(str(text))
    lo = r.agg(F.min("ts")).first()[0].date().isoformat()
    hi = r.agg(F.max("ts")).first()[0].date().isoformat()
    p = contract.P
    cfg = PreprocessConfig.from_dict({
        "input_path": str(text), "analysis_window": [lo, hi], "timezone": p.tz,
        "inactive_filter": {"nonzero_rate_min": p.rate_min, "max_consecutive_zeros_hours_max": p.run_max},
        "save": {"master_wide_hourly_path": str(tmp_path / "master"), "metadata_path": str(tmp_path / "meta.json"),
                 "aggregate_hourly_path": str(tmp_path / "agg")}})
    res = run_preprocess(spark, cfg)
    doc = json.loads(read_text_file(spark, cfg.save.metadata_path))
    want = {x["client_id"]: x["status"] for x in contract.q_a07_active_clients(spark, SF).collect()}
    assert doc["active_clients"] == sorted(c for c, s in want.items() if s == "active")
    assert doc["dropped_clients"] == sorted(c for c, s in want.items() if s == "dropped")
    assert res["master"]["series"] == len(doc["active_clients"])
    # the aggregate written by the job equals the contract's aggregate load
    agg = {x["timestamp"]: x["aggregate_hourly_kW"] for x in spark.read.parquet(cfg.save.aggregate_hourly_path).collect()}
    ref = {x["ts"]: x["aggregate_hourly_kW"] for x in contract.q_a10_aggregate_load(spark, SF).collect()}
    assert agg.keys() == ref.keys()
    assert max(abs(agg[k] - ref[k]) for k in ref) < 1e-3
    # the master reads back to the active hourly panel
    back = read_master_wide(spark, cfg.save.master_wide_hourly_path)
    assert back.where(F.col("y").isNotNull()).count() == contract.q_p06_master_long(spark, SF).count()


def test_split_exports(spark, tmp_path):
    s = contract._e_splits(spark, SF)
    sinks.write_split_exports(s, s.select("client_id"), str(tmp_path / "splits"))
    long = spark.read.parquet(str(tmp_path / "splits" / "long"))
    assert long.count() == s.count()
    test_wide = spark.read.parquet(str(tmp_path / "splits" / "wide" / "values")).where("split = 'test'")
    assert test_wide.agg(F.min("timestamp")).first()[0] >= dt.datetime(2024, 1, 26)
    assert panel.split_overlap(s).count() == 0


def test_report_job(spark, tmp_path):
    from meterframe.plans import report
    s = contract.Scoring(spark, SF)
    rep = report.build(s.test, s.preds, contract.Scoring.MODELS, contract.P.slice_client,
                       *contract.P.chart_days, k_worst=2)
    report.write(rep, str(tmp_path / "report"))
    lb = spark.read.parquet(str(tmp_path / "report" / "leaderboard"))
    assert sorted(r["rank"] for r in lb.collect()) == [1, 2]
    chart = spark.read.parquet(str(tmp_path / "report" / "chart"))
    assert set(contract.Scoring.MODELS) <= set(chart.columns)
    assert chart.where(F.col("client_id") != contract.P.slice_client).count() == 0
    worst = spark.read.parquet(str(tmp_path / "report" / "worst_series"))
    assert worst.count() == 4


@pytest.mark.parametrize("model", ["ets", "global_linear"])
def test_modeling_job(spark, tmp_path, model):
    from meterframe.plans import forecast_jobs, modeling
    p = forecast_jobs.forecast_panel(spark, SF).drop("split")
    res = modeling.run_model(spark, p, model, str(tmp_path / model), bounds=contract.P.bounds,
                             lookback=96, chunk=48, input_size=96)
    mets = spark.read.parquet(str(tmp_path / model / "metrics"))
    phases = {r["phase"] for r in mets.where(F.col("client_id") == "OVERALL").collect()}
    assert {"validation", "test"} <= phases
    preds = spark.read.parquet(str(tmp_path / model / "predictions"))
    n_series = p.select("client_id").distinct().count()
    # span horizon: every validation hour of every series is forecast
    val_hours = p.where((F.col("ts") >= "2024-01-21") & (F.col("ts") < "2024-01-26")).select("ts").distinct().count()
    assert preds.where(F.col("phase") == "validation").count() == n_series * val_hours
    if model != "global_linear":
        models = spark.read.parquet(str(tmp_path / model / "models" / model))
        assert models.where("status = 'ok'").groupBy("phase").count().collect() == \
            models.groupBy("phase").agg(F.lit(n_series).cast("long").alias("count")).collect()
        status = spark.read.parquet(str(tmp_path / model / "status")).collect()
        assert {(r.phase, r.status, r.series) for r in status} == {(p, "ok", n_series) for p in ("validation", "test")}


def test_survey_invariants(spark):
    """active + dropped = all series (disjoint); sum of the aggregate series =
    sum of the active hourly panel."""
    status = {r["client_id"]: r["status"] for r in contract.q_a07_active_clients(spark, SF).collect()}
    all_ids = {r[0] for r in contract.e_readings(spark, SF).select("client_id").distinct().collect()}
    assert set(status) == all_ids and set(status.values()) <= {"active", "dropped"}
    agg = contract.q_a10_aggregate_load(spark, SF).agg(F.sum("aggregate_hourly_kW")).first()[0]
    e = contract._e(spark, SF)
    active = e.stats.where("active").select("client_id")
    panel_sum = panel.select_clients(e.hourly, active).agg(F.sum(F.col("y").cast("double"))).first()[0]
    assert abs(agg - panel_sum) < 1e-2
