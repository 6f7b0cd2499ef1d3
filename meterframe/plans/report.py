"""Model comparison report (the data behind the reference's dashboard, §3.3):
metrics by model per series and overall (A14), leaderboard and worst series
(A20), and actual vs. predicted of one series over a date range (F13, J3, P7).

Inputs are long tables: actuals ``client_id, ts, y`` and predictions
``model, client_id, ts, yhat`` (any number of models).  Everything is
computed by Spark; the report is written as Parquet data sets.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..schema import CLIENT, MODEL, TS, Y
from ..session import local_session
from ..sources.readers import read_master_wide


@dataclass(frozen=True)
class Report:
    metrics: DataFrame          # model, client_id (incl. OVERALL), MSE, MAE, WAPE
    leaderboard: DataFrame      # model, MSE, MAE, WAPE, rank
    worst: DataFrame            # model, client_id, MSE, MAE, WAPE, rank
    chart: DataFrame            # client_id, ts, y, one column per model


def build(actuals: DataFrame, preds: DataFrame, models: list[str], client: str,
          start_day: str, end_day: str, k_worst: int = 5) -> Report:
    """Dashboard rules: missing pairs are ignored, metrics unrounded.  The
    predictions are left-joined so a model without a value at some hour does
    not drop the actual (as the dashboard's chain of left merges)."""
    act = actuals.select(CLIENT, TS, Y)
    metrics = evaluate.metrics_by_model(act, preds, null_safe=True, how="inner")
    chart_long = evaluate.actual_vs_predicted(act, preds, client, start_day, end_day)
    chart = (chart_long.groupBy(CLIENT, TS, Y).pivot(MODEL, list(models))
             .agg(F.first("yhat", ignorenulls=True)))
    return Report(metrics=metrics,
                  leaderboard=evaluate.leaderboard(metrics),
                  worst=evaluate.worst_series(metrics, k_worst),
                  chart=chart)


def write(report: Report, base: str) -> None:
    report.metrics.write.mode("overwrite").partitionBy(MODEL).parquet(f"{base}/metrics")
    report.leaderboard.write.mode("overwrite").parquet(f"{base}/leaderboard")
    report.worst.write.mode("overwrite").parquet(f"{base}/worst_series")
    report.chart.write.mode("overwrite").parquet(f"{base}/chart")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Compare the predictions of several models.")
    ap.add_argument("--panel", required=True, help="wide hourly master")
    ap.add_argument("--predictions", required=True, nargs="+", help="Parquet data sets of model, client_id, ts, yhat")
    ap.add_argument("--out", required=True)
    ap.add_argument("--client", required=True, help="series of the chart")
    ap.add_argument("--start", required=True, help="first day of the chart")
    ap.add_argument("--end", required=True, help="last day of the chart")
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    preds = spark.read.parquet(*args.predictions).select(MODEL, CLIENT, TS, "yhat")
    models = sorted(r[0] for r in preds.select(MODEL).distinct().collect())     # the chart's columns
    rep = build(read_master_wide(spark, args.panel), preds, models, args.client, args.start, args.end)
    write(rep, args.out)
    for r in spark.read.parquet(f"{args.out}/leaderboard").orderBy("rank").collect():
        print(f"{r['rank']}. {r[MODEL]}: WAPE {r['WAPE']}  MAE {r['MAE']}  MSE {r['MSE']}")


if __name__ == "__main__":
    main()
