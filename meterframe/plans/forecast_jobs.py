"""Forecasting jobs on the driver's tables.

Panel: ``events`` as readings (series = user), hourly means (A2) on the
retained hour axis, densified with an hour without events counted as zero
load, split into train / validation / test like the contract queries.  The
number of series and the work grow with the table.  The SQL counterparts are in
:mod:`.forecast_sql`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..forecast import additive, arima, backtest, global_model, jobs
from ..operators import aggregate, evaluate, panel, resample
from ..operators.reshape import as_single_series
from ..schema import CLIENT, MODEL, SPLIT, TS, Y, YHAT
from ..session import checkpoint_dir
from ..sources import sinks
from ..sources.sinks import stored
from .contract import P, _e, l_readings, r4, r6


def forecast_panel(spark, sf) -> DataFrame:
    """The split panel, written once to the checkpoint folder: every phase,
    horizon count and score reads it, and a lost executor does not send the
    job back to the raw table."""
    e = _e(spark, sf, materialize=True)
    dense = resample.densify(e.hourly, e.spine, e.clients, e.lo, e.hi)
    dense = dense.withColumn(Y, F.coalesce(F.col(Y), F.lit(0.0)).cast("float"))
    return stored(panel.assign_splits(dense, P.bounds), "forecast-panel")


def _part(df, name):
    return df.where(F.col(SPLIT) == name).select(CLIENT, TS, Y)


LOOKBACK = 672
# pooled model on the 30-day tables: one week of input, three-day chunks; on the tables of years the reference's sizes
REFERENCE_INPUT, REFERENCE_CHUNK = 672, 720
GLOBAL_INPUT = 168
GLOBAL_CHUNK = 72


#: Order and differences of the query on coefficients.
FIXED = arima.Settings(order=(2, 1, 1, 0), differences=(0, 1))


def _rounded(preds):
    return preds.select(MODEL, CLIENT, TS, r4(YHAT).alias(YHAT))


def _val_forecast(spark, sf, model, lookback=LOOKBACK):
    p = forecast_panel(spark, sf)
    preds, *_ = backtest.run_phase(_part(p, "train"), _part(p, "validation"), model, lookback, mode="count")
    return _rounded(preds)


def q_f01_ets(spark, sf):
    return _val_forecast(spark, sf, "ets")


def q_f02_arima(spark, sf):
    return _val_forecast(spark, sf, "arima")


def q_f03_arimax(spark, sf):
    return _val_forecast(spark, sf, "arimax")


def q_f03_coefficients(spark, sf):
    """Weights of a fixed order with regressors: one row per series and column
    (beta: constant and calendar, weight: lags, innovations, constant)."""
    train = jobs.recent(_part(forecast_panel(spark, sf), "train"), LOOKBACK)
    table = arima.fit(train, FIXED, regressors=True)
    return table.select(CLIENT, F.explode(F.map_from_arrays(F.array(F.lit("beta"), F.lit("weight")), F.array("beta", "weight")))
                        .alias("part", "v")).select(CLIENT, "part", F.posexplode("v").alias("column", "value")) \
        .select(CLIENT, "part", "column", r6("value").alias("value"))


def q_f04_additive(spark, sf):
    return _val_forecast(spark, sf, "additive", None)


def q_f04_coefficients(spark, sf):
    """Trend, seasonal and weekend coefficients: one row per series and column."""
    table = additive.fit(_part(forecast_panel(spark, sf), "train"))
    return table.select(CLIENT, F.posexplode("beta").alias("column", "value")) \
        .select(CLIENT, "column", r6("value").alias("value"))


def q_f05_aggregate_arima(spark, sf):
    e = _e(spark, sf)
    agg = aggregate.aggregate_load(e.hourly, e.spine)
    series = panel.assign_splits(as_single_series(agg, aggregate.AGG_COL), P.bounds)
    preds, *_ = backtest.run_phase(_part(series, "train"), _part(series, "validation"), "arima", LOOKBACK)
    return _rounded(preds)


def q_f06_in_sample(spark, sf):
    p = forecast_panel(spark, sf)
    train = jobs.recent(_part(p, "train"), LOOKBACK)
    return evaluate.metrics_table(evaluate.in_sample_pairs(train, jobs.fitted(train, "arima").drop(MODEL), generated=True),
                                  null_safe=False, digits=4)


def q_f08_backtest(spark, sf):
    _, mets, _ = backtest.backtest(forecast_panel(spark, sf), "ets", LOOKBACK, mode="span")
    return mets


def q_j05_fitted_series(spark, sf):
    """Series of the whole panel, fitted and skipped: a few series are given without any value."""
    train = jobs.recent(_part(forecast_panel(spark, sf), "train"), LOOKBACK)
    gone = train.withColumn(Y, F.when(F.col(CLIENT).cast("long") % 10 != 0, F.col(Y)))
    return jobs.status_counts(jobs.fit(gone, "ets").select(MODEL, "status"))


def _global(spark, sf):
    p = forecast_panel(spark, sf)
    train, val, test = _part(p, "train"), _part(p, "validation"), _part(p, "test")
    w = global_model.fit(panel.union_history(train, val), input_size=GLOBAL_INPUT, chunk=GLOBAL_CHUNK)
    return train, val, test, w


def q_f09_rolling(spark, sf):
    train, val, test, w = _global(spark, sf)
    preds = global_model.rolling_forecast(w, panel.union_history(train, val), test.select(CLIENT, TS),
                                          input_size=GLOBAL_INPUT, chunk=GLOBAL_CHUNK)
    return evaluate.metrics_table(evaluate.scored(test, preds.drop(MODEL), generated=True), digits=4)


def q_f10_global(spark, sf):
    train, val, test, w = _global(spark, sf)
    return _rounded(global_model.predict(w, panel.union_history(train, val), GLOBAL_CHUNK, GLOBAL_INPUT))


def q_f10_moments(spark, sf):
    """Moment sums of the pooled model at the reference's sizes (672 hours in, 720
    out) over the daily readings of all years: one row per sum, and the rows
    used and without a window."""
    hourly = stored(resample.hourly_mean(l_readings(spark, sf)), "hourly")
    r = global_model.moment_row(hourly, REFERENCE_INPUT, REFERENCE_CHUNK)
    sums = r.select(F.posexplode("sums").alias("number", "value")).select("number", r4("value").alias("value"))
    counts = r.select(F.explode(F.array(F.struct(F.lit(-1).alias("number"), F.col("rows").cast("double").alias("value")),
                                        F.struct(F.lit(-2).alias("number"), F.col("short").cast("double").alias("value"))))
                      .alias("c")).select("c.*")
    return sums.unionByName(counts)


def q_f10_reference_sizes(spark, sf):
    """Forecasts of the next 720 hours of every series from its last 672."""
    hourly = stored(resample.hourly_mean(l_readings(spark, sf)), "hourly")
    w = global_model.fit(hourly, REFERENCE_INPUT, REFERENCE_CHUNK)
    return _rounded(global_model.predict(w, hourly, REFERENCE_CHUNK, REFERENCE_INPUT))


def q_f11_global_proxy(spark, sf):
    train, val, test, w = _global(spark, sf)
    pairs = global_model.in_sample_proxy(w, train, panel.horizon(val), input_size=GLOBAL_INPUT, chunk=GLOBAL_CHUNK)
    return evaluate.metrics_table(pairs, digits=4)


def q_f12_by_name(spark, sf):
    p = forecast_panel(spark, sf)
    train, val = _part(p, "train"), _part(p, "validation")
    preds = backtest.predictions_by_name(["ets", "arima"], train, val, LOOKBACK)
    lb = evaluate.leaderboard(evaluate.metrics_by_model(val, preds, generated=True))
    return lb.select(MODEL, *[r4(c).alias(c) for c in ("MSE", "MAE", "WAPE")], "rank")


def q_s14_model_table(spark, sf):
    """Model tables of two phases written by partition, one of them again, read
    back, and the stored validation table asked for the validation hours."""
    p = forecast_panel(spark, sf)
    train, val = _part(p, "train"), _part(p, "validation")
    path = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    for phase, hist in (("test", panel.union_history(train, val)), ("validation", train)):
        table = jobs.fit(jobs.recent(hist, LOOKBACK), "arima").withColumn(backtest.PHASE, F.lit(phase))
        sinks.write_model_table(table, path)
    table = sinks.read_model_table(spark, path).where(F.col(backtest.PHASE) == "validation")
    return _rounded(jobs.forecast_at(table, "arima", val.select(CLIENT, TS)))


def queries() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    from . import forecast_sql
    return forecast_sql.oracle_sql()
