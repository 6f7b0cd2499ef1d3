"""Preprocessing job: wide 15-minute text -> hourly master of active series,
summed series and metadata document (S1-S8, A1-A11, W1-W3, P1, P3, A19).

Run as ``spark-submit run_job.py preprocess --config config.json``
(or ``python -m meterframe.plans.preprocess``).  Stages:

1. read + window (S1-S4, P1), average duplicates (A1), integrity report (A4)
2. hourly means (A2), transition days (W2), artefact snapshot (A11),
   drop those days (P3), activity (A5-A7, A9), incomplete days (A8)
3. write wide master (S6), aggregate (S7), metadata (S8)

The de-duplicated readings and the per-series statistics are reused by
several actions, so they are written as Parquet to the folder the cluster
names in ``spark.checkpoint.dir``: the lineage is cut, the loss of executors
repeats one stage, and readers still get column pruning.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DOWNSAMPLE_RULE, PreprocessConfig, load_config
from ..operators import activity, aggregate, dst, integrity, panel, resample
from ..schema import CLIENT
from ..session import checkpoint_dir, local_session, size_shuffles
from ..sources import sinks
from ..sources.readers import read_wide_text


def prepare(spark: SparkSession, cfg: PreprocessConfig, raw: DataFrame | None = None) -> dict:
    """Steps 1-2 as DataFrames plus the small driver-side facts."""
    checkpoint_dir(spark)
    if raw is None:
        # text of a wide table: about 3x larger once unpivoted to long rows
        size_shuffles(spark, [cfg.input_path], expansion=3.0)
        raw = read_wide_text(spark, cfg.input_path, cfg.sep, cfg.decimal)
    raw = panel.analysis_window(raw, *cfg.analysis_window)
    readings = sinks.stored(resample.dedupe_mean(raw), "readings")
    report = integrity.integrity_report(readings, cfg.step_seconds, raw=raw).first().asDict()
    clients = readings.select(CLIENT).distinct()
    n_clients = report["clients"]

    # the hourly panel feeds the activity statistics, the master and the
    # aggregate: written once instead of re-aggregated per output
    hourly_all = sinks.stored(resample.hourly_mean(readings, dedupe=False), "hourly")
    lo, hi = resample.time_bounds(readings, hourly=True)
    dates = dst.transition_dates(spark, lo.date(), hi.date(), cfg.timezone)
    dates = sorted(r["day"] for r in dates.collect())   # two per year at most
    snapshot = dst.artefact_snapshot(readings, dates, n_clients).collect()
    hourly = dst.drop_days(hourly_all, dates)
    spine = dst.drop_days(resample.hour_spine(hourly_all, lo, hi), dates)
    f = cfg.inactive_filter
    stats = sinks.stored(activity.activity_stats(hourly, clients, lo, hi, dates, f.nonzero_rate_min,
                                                 f.max_consecutive_zeros_hours_max), "client-stats")
    active = activity.active_clients(stats)
    hourly_active = hourly.join(active, CLIENT, "left_semi")
    return dict(raw=raw, readings=readings, report=report, clients=clients, hourly=hourly,
                hourly_active=hourly_active, spine=spine, stats=stats, active=active,
                dates=dates, snapshot=snapshot, lo=lo, hi=hi)


def series_lists(cfg: PreprocessConfig, st: dict) -> dict[str, DataFrame]:
    """The per-series entries of the metadata document (S8), as DataFrames; a
    configuration with ``inline_lists = false`` has them in the client
    statistics data set only (NULL in the document)."""
    if not cfg.save.inline_lists:
        return {}
    stats = st["stats"]
    return {"active_clients": stats.where("active").select(CLIENT), "dropped_clients": stats.where("not active").select(CLIENT),
            "first_nonzero_timestamp": activity.first_nonzero_text(stats).select(CLIENT, "first_nonzero")}


def metadata_document(cfg: PreprocessConfig, st: dict) -> dict:
    """The metadata document (S8) without its per-series entries."""
    active = dropped = first_nz = None
    bad_days = [r["date"] for r in activity.incomplete_days(st["spine"]).orderBy("date").collect()]
    rep = {k: st["report"][k] for k in ("rows", "clients", "start", "end",
                                         "duplicate_timestamps", "non_15m_intervals")}
    f = cfg.inactive_filter
    # fixed values: the keys of the published metadata document
    return {
        "target_definition": cfg.target_definition,
        "downsample_rule": DOWNSAMPLE_RULE,
        "dst_policy": cfg.dst_policy,
        "dst_dropped_dates": [d.isoformat() for d in st["dates"]],
        "inactive_filter_rule": {"nonzero_rate_min": f.nonzero_rate_min,
                                 "max_consecutive_zeros_hours_max": f.max_consecutive_zeros_hours_max},
        "active_clients": active,
        "dropped_clients": dropped,
        "analysis_window": {"start": cfg.analysis_window[0], "end": cfg.analysis_window[1]},
        "integrity_report": rep,
        "dst_detection_artifact_snapshot": {
            r["date"]: {"rows_01_to_02": r["rows_01_to_02"],
                        "all_client_zero_row_rate": r["all_client_zero_row_rate"]}
            for r in st["snapshot"]},
        "inconsistent_daily_steps_after_dst_drop": bad_days,
        "first_nonzero_timestamp": first_nz,
    }


def run_preprocess(spark: SparkSession, cfg: PreprocessConfig, raw: DataFrame | None = None) -> dict:
    """Steps 1-3; returns the run summary."""
    st = prepare(spark, cfg, raw)
    doc = metadata_document(cfg, st)
    n_active = st["active"].count()
    if cfg.save.master_layout == "long":
        sinks.write_master_long(st["hourly_active"], cfg.save.master_wide_hourly_path)
    elif cfg.save.master_layout == "blocks":
        sinks.write_master_blocks(st["hourly_active"], st["active"], cfg.save.master_wide_hourly_path)
    else:
        names = [r[0] for r in st["active"].orderBy(CLIENT).toLocalIterator()]   # the table's columns
        sinks.write_master_wide(st["hourly_active"], names, cfg.save.master_wide_hourly_path)
    sinks.write_metadata(spark, doc, cfg.save.metadata_path, series_lists(cfg, st))
    if cfg.save.client_list_path:
        sinks.write_client_list(st["active"], cfg.save.client_list_path)
    if cfg.save.calendar_path:
        sinks.write_calendar(st["spine"], cfg.save.calendar_path)
    if cfg.save.splits_path:
        split = panel.assign_splits(st["hourly_active"], panel.SplitBounds(**cfg.splits))
        sinks.write_split_exports(split, st["active"], cfg.save.splits_path)
    if cfg.save.aggregate_hourly_path:
        agg = aggregate.aggregate_load(st["hourly"], st["spine"], keep=st["active"])
        sinks.write_aggregate(agg, cfg.save.aggregate_hourly_path)
    if cfg.save.client_stats_path:
        st["stats"].write.mode("overwrite").parquet(cfg.save.client_stats_path)
    n_hours = st["spine"].count()
    n_dropped = st["report"]["clients"] - n_active
    return {
        "readings": {"timestamps": st["report"]["rows"], "series": st["report"]["clients"]},
        "master": {"hours": n_hours, "series": n_active},
        "dropped": n_dropped,
        "removed_days": doc["dst_dropped_dates"],
        "short_days": doc["inconsistent_daily_steps_after_dst_drop"],
    }


def summary_text(result: dict) -> str:
    r, m = result["readings"], result["master"]
    short = result["short_days"]
    return "\n".join([
        f"read {r['timestamps']} timestamps of {r['series']} series",
        f"kept {m['series']} active series over {m['hours']} hours, dropped {result['dropped']}",
        "removed transition days: " + (", ".join(result["removed_days"]) or "none"),
        "days without 24 hours: " + (f"{len(short)} (first {short[0]})" if short else "none")])


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Hourly master of active series from wide 15-minute readings.")
    ap.add_argument("--config", default="config.json")
    args = ap.parse_args(argv)
    cfg = load_config(args.config)
    spark = SparkSession.getActiveSession() or local_session()
    print(summary_text(run_preprocess(spark, cfg)))


if __name__ == "__main__":
    main()

