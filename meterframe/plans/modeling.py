"""Modelling job: the reference's notebook flow as one Spark job.

Load the hourly panel (wide master Parquet, S9 + R1, or long CSV/Parquet,
S10), keep the selected series (P5), split chronologically (P2), then

* per-series models (``ets``, ``arima``, ``arimax``, ``additive``): fit on the
  train lookback, forecast and score validation, refit on train + validation
  and score test (F8); write predictions, metrics and the model table (S14);
* the pooled model (``global_linear``): fit on train + validation, rolling
  chunked forecast over validation and test (F9, F10), in-sample proxy on
  train (F11).

``spark-submit run_job.py model --panel master.parquet --model ets --out results/``
(bounds default to the reference's split dates).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import backtest, global_model, jobs
from ..operators import evaluate, panel
from ..schema import CLIENT, SPLIT, TS, Y
from ..session import checkpoint_dir, local_session
from ..sources import sinks
from ..sources.readers import read_long_csv, read_master_wide

# The reference's split bounds (inclusive, hourly grain),
# 4-week lookback, 720-hour chunks and 672-hour input of the global model.
REFERENCE_BOUNDS = panel.SplitBounds(
    train_start="2012-01-01 00:00:00", train_end="2013-12-31 23:00:00",
    val_start="2014-01-01 00:00:00", val_end="2014-04-30 23:00:00",
    test_start="2014-05-01 00:00:00")
LOOKBACK_HOURS = 672
CHUNK_HOURS = 720
INPUT_HOURS = 672


def load_panel(spark: SparkSession, path: str, fmt: str = "master") -> DataFrame:
    if fmt == "master":
        return read_master_wide(spark, path)
    if fmt == "csv":
        return read_long_csv(spark, path)
    return spark.read.parquet(path).select(CLIENT, TS, F.col(Y).cast("float").alias(Y))


def run_model(spark: SparkSession, panel_df: DataFrame, model: str, out: str | None = None,
              bounds: panel.SplitBounds = REFERENCE_BOUNDS, lookback: int | None = LOOKBACK_HOURS,
              horizon: str = "span", clients: DataFrame | None = None,
              chunk: int = CHUNK_HOURS, input_size: int = INPUT_HOURS,
              rolling: str = "remaining") -> dict[str, DataFrame]:
    """Returns ``predictions`` and ``metrics`` (with ``phase``) and, for per-series
    models, ``models`` (the model tables) and ``status`` (series by phase and
    status: what was fitted and what was skipped)."""
    checkpoint_dir(spark)
    if clients is not None:
        panel_df = panel.select_clients(panel_df, clients)
    split = sinks.stored(panel.assign_splits(panel_df.select(CLIENT, TS, Y), bounds), "panel")
    part = {n: split.where(F.col(SPLIT) == n).select(CLIENT, TS, Y) for n in ("train", "validation", "test")}
    present = {r[0] for r in split.select(SPLIT).distinct().collect()}      # at most three
    missing = [n for n in part if n not in present]
    if missing:
        raise ValueError(f"no rows in split(s) {missing} for bounds {bounds}")
    if model == global_model.NAME:
        history = panel.union_history(part["train"], part["validation"])
        w = global_model.fit(history, input_size, chunk)
        preds, mets = [], []
        for phase, hist, target in (("validation", part["train"], part["validation"]),
                                    ("test", history, part["test"])):
            p = global_model.rolling_forecast(w, hist, target.select(CLIENT, TS), input_size, chunk,
                                              variant=rolling)
            preds.append(p.withColumn("phase", F.lit(phase)))
            pairs = evaluate.scored(target, p.drop("model"), generated=True)
            mets.append(evaluate.metrics_table(pairs, null_safe=False, digits=4).withColumn("phase", F.lit(phase)))
        proxy = global_model.in_sample_proxy(w, part["train"], panel.horizon(part["validation"]),
                                             input_size, chunk)
        mets.append(evaluate.metrics_table(proxy, null_safe=False, digits=4).withColumn("phase", F.lit("train_proxy")))
        result = {"predictions": preds[0].unionByName(preds[1]),
                  "metrics": mets[0].unionByName(mets[1]).unionByName(mets[2])}
    else:
        preds, mets, tables = backtest.backtest(split, model, lookback, horizon)
        result = {"predictions": preds, "metrics": mets, "models": tables,
                  "status": tables.groupBy(backtest.PHASE, "model", "status").agg(F.count("*").alias("series"))}
    if out:
        sinks.write_partitions(result["predictions"], f"{out}/predictions", backtest.PHASE)
        result["metrics"].write.mode("overwrite").parquet(f"{out}/metrics")
        if "models" in result:
            sinks.write_model_table(result["models"], f"{out}/models/{model}")
            result["status"].write.mode("overwrite").parquet(f"{out}/status")
    return result


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Fit, forecast and score one model on an hourly panel.")
    ap.add_argument("--panel", required=True)
    ap.add_argument("--format", default="master", choices=["master", "csv", "long"])
    ap.add_argument("--model", required=True, choices=[*jobs.REGISTRY, global_model.NAME])
    ap.add_argument("--out", required=True)
    ap.add_argument("--horizon", default="span", choices=["span", "count"])
    ap.add_argument("--lookback", type=int, default=LOOKBACK_HOURS)
    ap.add_argument("--rolling", default="remaining", choices=["remaining", "chunks"],
                    help="pooled model: remaining-set loop or the notebook's chunk slices")
    ap.add_argument("--chunk", type=int, default=CHUNK_HOURS, help="pooled model: hours per round")
    ap.add_argument("--input-size", type=int, default=INPUT_HOURS, help="pooled model: input hours")
    b = REFERENCE_BOUNDS
    ap.add_argument("--train-start", default=b.train_start)
    ap.add_argument("--train-end", default=b.train_end)
    ap.add_argument("--val-start", default=b.val_start)
    ap.add_argument("--val-end", default=b.val_end)
    ap.add_argument("--test-start", default=b.test_start)
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    bounds = panel.SplitBounds(train_start=args.train_start or None, train_end=args.train_end,
                               val_start=args.val_start, val_end=args.val_end, test_start=args.test_start)
    res = run_model(spark, load_panel(spark, args.panel, args.format), args.model, args.out,
                    bounds=bounds, lookback=args.lookback or None, horizon=args.horizon,
                    rolling=args.rolling, chunk=args.chunk, input_size=args.input_size)
    overall = res["metrics"].where(F.col(CLIENT) == evaluate.OVERALL).orderBy("phase").collect()
    for r in overall:
        print(f"{args.model} {r['phase']}: MSE {r['MSE']}  MAE {r['MAE']}  WAPE {r['WAPE']}")


if __name__ == "__main__":
    main()
