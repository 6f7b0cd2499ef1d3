"""Scoring forecasts against actuals.

Predictions are long: ``model, client_id, ts, yhat``.  Per-series sums are
computed once (one shuffle by series); the pooled OVERALL row is then summed
from those per-series partial sums, so it never re-reads the rows and never
funnels them through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null, round_half_up
from ..schema import CLIENT, MODEL, TS, Y, YHAT
from .panel import drop_incomplete
from .partitioning import matched

OVERALL = "OVERALL"


def _paired(actuals: DataFrame, preds: DataFrame, keys: list[str], how: str, generated: bool) -> DataFrame:
    return matched(actuals, preds, keys, how) if generated else actuals.join(preds, keys, how)


def scored(actuals: DataFrame, preds: DataFrame, keys=(CLIENT, TS), generated: bool = False) -> DataFrame:
    """Only (series, time) pairs present on both sides are scored.

    Here and below ``generated`` says that the predictions come out of model
    tables: then both sides are dealt out by the rows of ``actuals`` (counted),
    and never broadcast."""
    return _paired(actuals, preds, list(keys), "inner", generated)


def in_sample_pairs(train: DataFrame, fitted: DataFrame, generated: bool = False) -> DataFrame:
    """Train left-joined with in-sample fitted values, then rows with a
    missing side dropped (P12)."""
    return drop_incomplete(_paired(train, fitted, [CLIENT, TS], "left", generated), [Y, YHAT])


def _partial_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    # NaN is missing, on either side: it must never score
    y, p = nan_to_null(F.col(Y).cast("double")), nan_to_null(F.col(YHAT).cast("double"))
    ok = y.isNotNull() & p.isNotNull()
    e = F.when(ok, y - p)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(e).alias("_n"),
        F.sum(e * e).alias("_sq"),
        F.sum(F.abs(e)).alias("_ab"),
        F.sum(F.when(ok, F.abs(y))).alias("_den"))


def _finish(sums: DataFrame, keys: list[str], null_safe: bool, digits: int | None) -> DataFrame:
    n = F.col("_n").cast("double")
    mse = F.try_divide(F.col("_sq"), F.nullif(n, F.lit(0.0)))
    mae = F.try_divide(F.col("_ab"), F.nullif(n, F.lit(0.0)))
    wape = F.try_divide(F.col("_ab"), F.nullif(F.col("_den"), F.lit(0.0)))
    if not null_safe:
        complete = F.col("_rows") == F.col("_n")
        mse, mae, wape = (F.when(complete, c) for c in (mse, mae, wape))
    vals = {"MSE": mse, "MAE": mae, "WAPE": wape}
    if digits is not None:
        vals = {k: round_half_up(v, digits) for k, v in vals.items()}
    return sums.select(*keys, *[v.alias(k) for k, v in vals.items()])


def metrics_table(pairs: DataFrame, null_safe: bool = True, digits: int | None = None,
                  by_model: bool = False) -> DataFrame:
    """A12/A13 (and A14 with ``by_model``): one row per series plus a pooled
    ``OVERALL`` row (per model).  Columns: ``[model,] client_id, MSE, MAE, WAPE``.

    Notebook rules: ``null_safe=False, digits=4``.  Dashboard rules (default):
    missing pairs ignored, zero denominator -> NULL, unrounded.
    """
    group = [MODEL] if by_model else []
    per = _partial_sums(pairs, group + [CLIENT])
    tot = (per.groupBy(*group)
           .agg(*[F.sum(c).alias(c) for c in ("_rows", "_n", "_sq", "_ab", "_den")])
           .withColumn(CLIENT, F.lit(OVERALL)))
    both = per.unionByName(tot)
    return _finish(both, group + [CLIENT], null_safe, digits)


def metrics_by_model(actuals: DataFrame, preds: DataFrame, null_safe: bool = True,
                     digits: int | None = None, how: str = "inner", generated: bool = False) -> DataFrame:
    """Per model and series, plus OVERALL per model."""
    pairs = _paired(actuals.select(CLIENT, TS, Y), preds, [CLIENT, TS], how, generated)
    return metrics_table(pairs, null_safe, digits, by_model=True)


def wide_by_model(actuals: DataFrame, preds: DataFrame, models: list[str]) -> DataFrame:
    """Actuals plus one column per model.  Predictions are pivoted once
    (explicit model list) and joined once, instead of one join per model."""
    wide = (preds.groupBy(CLIENT, TS).pivot(MODEL, list(models))
            .agg(F.first(YHAT, ignorenulls=True)))
    return actuals.select(CLIENT, TS, Y).join(wide, [CLIENT, TS], "left")


def actual_vs_predicted(actuals: DataFrame, preds: DataFrame, client: str,
                        start_day: str, end_day: str) -> DataFrame:
    """one series and a date range, every model (the chart's data), in
    long layout: ``client_id, ts, y, model, yhat``."""
    d = F.to_date(F.col(TS))
    keep = ((F.col(CLIENT) == F.lit(client)) & (d >= F.lit(start_day).cast("date"))
            & (d <= F.lit(end_day).cast("date")))
    a = actuals.where(keep).select(CLIENT, TS, Y)
    p = preds.where(keep)
    return a.join(p, [CLIENT, TS], "left")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models ranked by overall WAPE (then MSE)."""
    overall = metrics.where(F.col(CLIENT) == OVERALL)
    w = Window.orderBy(F.col("WAPE").asc_nulls_last(), F.col("MSE").asc_nulls_last(), MODEL)
    return overall.select(MODEL, "MSE", "MAE", "WAPE",
                          F.rank().over(w).cast("int").alias("rank"))


def worst_series(metrics: DataFrame, k: int = 5, by: str = "MSE") -> DataFrame:
    """A20 outliers: per model the ``k`` series with the largest ``by``.
    A top-k report; the limit is the feature."""
    w = Window.partitionBy(MODEL).orderBy(F.col(by).desc_nulls_last(), CLIENT)
    return (metrics.where(F.col(CLIENT) != OVERALL)
            .withColumn("rank", F.row_number().over(w).cast("int"))
            .where(F.col("rank") <= k))


def skipped_series(panel: DataFrame, models: DataFrame) -> DataFrame:
    """Series of the panel without a fitted model (scored as absent)."""
    return panel.select(CLIENT).distinct().join(models.select(CLIENT).distinct(), CLIENT, "left_anti")
