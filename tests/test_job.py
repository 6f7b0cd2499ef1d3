"""Preprocessing job end to end (S5-S8) and config validation."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from meterframe.config import PreprocessConfig, load_config
from meterframe.plans.preprocess import run_preprocess, summary_text
from meterframe.sources.readers import read_master_blocks
from meterframe.sources.sinks import read_text_file


def _config(tmp_path, data_path, aggregate=True, **save):
    # fixed values: the key names of the configuration file
    cfg = {
        "input_path": data_path,
        "target_definition": "hourly_kW_mean_of_4",
        "analysis_window": ["2013-06-10", "2013-06-11"],
        "timezone": "Europe/Lisbon",
        "dst_policy": "drop_entire_transition_days",
        "inactive_filter": {"nonzero_rate_min": 0.2, "max_consecutive_zeros_hours_max": 20},
        "save": {"master_wide_hourly_path": str(tmp_path / "out" / "master.parquet"),
                 "metadata_path": str(tmp_path / "out" / "meta.json"),
                 "aggregate_hourly_path": str(tmp_path / "out" / "agg.parquet") if aggregate else "", **save},
    }
    p = tmp_path / "config.json"
    p.write_text(json.dumps(cfg))
    return str(p)


def _house_text(tmp_path):
    """Two days: ``roof`` gives power by day with a decimal comma, ``shed`` is
    used for one hour only, ``pump`` misses the first evening."""
    lines = ["when;pump;roof;shed"]
    for step in range(2 * 96):
        day, hour, minute = 10 + step // 96, step % 96 // 4, step % 4 * 15
        roof = f"{(hour - 5) / 2:.1f}".replace(".", ",") if 6 <= hour < 20 else "0"
        pump = "" if day == 10 and hour >= 21 else "3"
        shed = "8" if (day, hour) == (11, 7) else "0"
        lines.append(f"2013-06-{day} {hour:02d}:{minute:02d}:00;{pump};{roof};{shed}")
    p = tmp_path / "house.txt"
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_job_end_to_end(spark, tmp_path):
    cfg = load_config(_config(tmp_path, _house_text(tmp_path)))
    res = run_preprocess(spark, cfg)
    assert res == {"readings": {"timestamps": 192, "series": 3}, "master": {"hours": 48, "series": 2},
                   "dropped": 1, "removed_days": [], "short_days": []}
    assert "kept 2 active series over 48 hours, dropped 1" in summary_text(res)
    master = spark.read.parquet(cfg.save.master_wide_hourly_path)
    assert master.columns == ["timestamp", "pump", "roof"]
    at = {str(r["timestamp"]): r for r in master.collect()}
    assert len(at) == 48
    assert at["2013-06-10 12:00:00"]["roof"] == 3.5 and at["2013-06-11 03:00:00"]["roof"] == 0.0
    assert at["2013-06-10 22:00:00"]["pump"] is None and at["2013-06-11 22:00:00"]["pump"] == 3.0
    agg = {str(r["timestamp"]): r["aggregate_hourly_kW"]
           for r in spark.read.parquet(cfg.save.aggregate_hourly_path).collect()}
    assert agg["2013-06-10 12:00:00"] == 6.5 and agg["2013-06-10 22:00:00"] == 0.0
    doc = json.loads(read_text_file(spark, cfg.save.metadata_path))
    assert doc["active_clients"] == ["pump", "roof"] and doc["dropped_clients"] == ["shed"]
    assert doc["integrity_report"]["rows"] == 192
    assert doc["first_nonzero_timestamp"] == {
        "pump": "2013-06-10 00:00:00", "roof": "2013-06-10 06:00:00", "shed": "2013-06-11 07:00:00"}


def test_layout_and_lists_are_configured(spark, tmp_path):
    path = _config(tmp_path, _house_text(tmp_path), aggregate=False, master_layout="long", inline_lists=False,
                   client_stats_path=str(tmp_path / "out" / "stats.parquet"))
    cfg = load_config(path)
    assert cfg.save.aggregate_hourly_path is None
    assert run_preprocess(spark, cfg)["master"] == {"hours": 48, "series": 2}
    assert not (tmp_path / "out" / "agg.parquet").exists()
    long = spark.read.parquet(cfg.save.master_wide_hourly_path)
    assert sorted(r[0] for r in long.select("client_id").distinct().collect()) == ["pump", "roof"]
    assert json.loads(read_text_file(spark, cfg.save.metadata_path))["active_clients"] is None
    assert spark.read.parquet(cfg.save.client_stats_path).count() == 3
    with pytest.raises(ValueError):
        load_config(_config(tmp_path, "x", inline_lists=False))
    with pytest.raises(ValueError):
        load_config(_config(tmp_path, "x", master_layout="tall"))


def test_job_writes_blocks_splits_calendar_and_client_list(spark, tmp_path):
    out = tmp_path / "out"
    path = _config(tmp_path, _house_text(tmp_path), aggregate=False, master_layout="blocks", splits_path=str(out / "splits"),
                   client_list_path=str(out / "clients"), calendar_path=str(out / "calendar"))
    d = json.loads(Path(path).read_text())
    d["splits"] = {"train_end": "2013-06-10 11:00:00", "val_start": "2013-06-10 12:00:00", "val_end": "2013-06-10 23:00:00",
                   "test_start": "2013-06-11 00:00:00"}
    Path(path).write_text(json.dumps(d))
    cfg = load_config(path)
    assert run_preprocess(spark, cfg)["master"] == {"hours": 48, "series": 2}
    long = read_master_blocks(spark, cfg.save.master_wide_hourly_path)
    at = {(r.client_id, str(r.ts)): r.y for r in long.collect()}
    assert at["roof", "2013-06-10 12:00:00"] == 3.5 and {c for c, _ in at} == {"pump", "roof"}
    assert sorted(r[0] for r in spark.read.option("header", True).csv(str(out / "clients")).collect()) == ["pump", "roof"]
    calendar = spark.read.option("header", True).csv(str(out / "calendar"))
    assert calendar.count() == 48 and calendar.columns[0] == "timestamp" and "hour_sin" in calendar.columns
    rows = {r["split"]: r["count"] for r in spark.read.parquet(str(out / "splits" / "long")).groupBy("split").count().collect()}
    assert rows == {"train": 24, "validation": 24, "test": 48}
    parts = spark.read.parquet(str(out / "splits" / "wide" / "values")).where("split = 'test'")
    assert parts.count() == 24 and "PartitionFilters: [isnotnull(split" in parts._jdf.queryExecution().executedPlan().toString()
    d["splits"] = None
    with pytest.raises(ValueError):
        PreprocessConfig.from_dict(d)


def test_documented_command_from_another_folder(tmp_path):
    """The launcher starts its own session, wherever it is called from."""
    cfg = _config(tmp_path, _house_text(tmp_path))
    script = Path(__file__).resolve().parents[1] / "run_job.py"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script), "preprocess", "--config", cfg], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=240, stdin=subprocess.DEVNULL)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "kept 2 active series over 48 hours, dropped 1" in out.stdout


def test_p4_rejects_unknown_policy(tmp_path):
    with pytest.raises(ValueError):
        PreprocessConfig.from_dict({"input_path": "x", "analysis_window": ["2011-01-01", "2011-01-02"],
                                    "dst_policy": "keep", "save": {"master_wide_hourly_path": "a",
                                                                   "metadata_path": "b"}})
    with pytest.raises(ValueError):
        PreprocessConfig.from_dict({"input_path": "x", "analysis_window": ["2011-01-01", "2011-01-02"],
                                    "target_definition": "daily", "save": {"master_wide_hourly_path": "a",
                                                                           "metadata_path": "b"}})


def test_shuffle_partitions_sized_from_input(spark, tmp_path):
    from meterframe.session import input_bytes, size_shuffles
    p = tmp_path / "x.txt"
    p.write_text("a" * 5000)
    assert input_bytes(spark, [str(p)]) == 5000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, [str(p)]) == 8          # floor of the range
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cli_entry_points(spark, tmp_path, capsys):
    """Both command-line jobs run from argv and print their summaries."""
    from meterframe.plans import modeling, preprocess
    cfg_path = _config(tmp_path, _house_text(tmp_path))
    preprocess.main(["--config", cfg_path])
    assert "kept 2 active series" in capsys.readouterr().out
    # a two-week hourly panel in long Parquet for the modelling job
    import datetime as dt
    import math
    rows = [("S", dt.datetime(2014, 4, 1) + dt.timedelta(hours=h), float(10 + 3 * math.sin(2 * math.pi * h / 24)))
            for h in range(24 * 14)]
    spark.createDataFrame(rows, "client_id string, ts timestamp_ntz, y float").write.parquet(str(tmp_path / "long"))
    modeling.main(["--panel", str(tmp_path / "long"), "--format", "long", "--model", "arima",
                   "--out", str(tmp_path / "res"), "--lookback", "96", "--train-start", "",
                   "--train-end", "2014-04-08 23:00:00", "--val-start", "2014-04-09 00:00:00",
                   "--val-end", "2014-04-11 23:00:00", "--test-start", "2014-04-12 00:00:00"])
    out = capsys.readouterr().out
    assert "arima validation: MSE" in out and "arima test: MSE" in out
