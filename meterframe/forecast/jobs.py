"""Forecasting by key on Spark.

A model is fitted on a long history, (client_id, ts, y), into a *model
table* of one typed row per series: ``model, client_id, last_ts, status`` and the
model's parameters and last state.  Forecasts and fitted values are long again.
Forecasts come from the table alone, so a stored table is never refitted.

Every model is one exchange by series and array expressions on the series' row
(:mod:`.arrays`); nothing leaves the JVM.  A series that cannot be fitted has its
reason in ``status`` and no forecast; it is counted (:func:`status_counts`), never
replaced by another model.  Rows without series id or time belong to no series.
"""

from __future__ import annotations

import ast
import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefns import ntz_lit
from ..operators import panel
from ..operators.partitioning import by_series, spread, tasks
from ..schema import CLIENT, MODEL, TS, YHAT
from . import additive, arima, smoothing

def _hour() -> Column:
    return F.expr("INTERVAL 1 HOUR")


@dataclass(frozen=True)
class Forecaster:
    """``fit(history)`` gives the model table; ``at(table, steps, rows)``
    puts forecasts next to the rows of ``table``: columns ts and yhat for each
    element of the array column ``steps`` (hours after the last value)."""
    name: str
    fit: Callable[[DataFrame], DataFrame]
    at: Callable[[DataFrame, Column], DataFrame]
    fitted: Callable[[DataFrame], DataFrame] | None = None


def _each(table: DataFrame, steps: Column) -> DataFrame:
    return table.select("*", F.explode(steps).alias("_step")).withColumn(TS, F.col("last_ts") + _hour() * F.col("_step"))


def _ets_at(table: DataFrame, steps: Column) -> DataFrame:
    return _each(table, steps).withColumn(YHAT, smoothing.value(F.col("_step")))


def _arima_at(table: DataFrame, steps: Column) -> DataFrame:
    """The path to the last step, of which the wanted steps are taken."""
    rows = table.withColumn("_path", arima.path(F.coalesce(F.array_max(steps), F.lit(0)).cast("int")))
    return _each(rows, steps).withColumn(
        YHAT, F.get("_path", (F.col("_step") - 1).cast("int")) + arima.explained(F.col(TS)))


def _additive_at(table: DataFrame, steps: Column) -> DataFrame:
    first = table.select("seasons").first()                    # the same in all rows of a fit
    seasons = ast.literal_eval(first[0]) if first else ()
    return _each(table, steps).withColumn(YHAT, additive.value(F.col(TS), seasons))


REGISTRY: dict[str, Forecaster] = {f.name: f for f in (
    Forecaster("ets", smoothing.fit, _ets_at, smoothing.fitted),
    Forecaster("arima", arima.fit, _arima_at, arima.fitted),
    Forecaster("arimax", partial(arima.fit, regressors=True), _arima_at, partial(arima.fitted, regressors=True)),
    Forecaster("additive", additive.fit, _additive_at))}


def recent(history: DataFrame, lookback: int | None) -> DataFrame:
    """The last ``lookback`` rows of each series (all, if None), dealt out by
    series and rows; ``history`` is counted for it."""
    rows = by_series(history)
    return panel.lookback(rows, lookback) if lookback else rows


def fit(history: DataFrame, model: str) -> DataFrame:
    """The model table of ``model`` on ``history``."""
    table = REGISTRY[model].fit(history)
    return table.select(F.lit(model).alias(MODEL), *table.columns)


def _predictions(table: DataFrame, model: str, steps: Column) -> DataFrame:
    return REGISTRY[model].at(table.where("status = 'ok'"), steps).select(MODEL, CLIENT, TS, YHAT)


def forecast(table: DataFrame, model: str, hours: int | None = None, until=None) -> DataFrame:
    """forecasts of the hours after each series' last value: ``hours`` of
    them (horizon by count, as the reference) or up to ``until`` (by span).
    Generated from the table's rows, without a join."""
    n = F.lit(hours) if until is None else F.timestamp_diff("HOUR", F.col("last_ts"), ntz_lit(until))
    n = F.greatest(n, F.lit(0)).cast("int")
    return _predictions(table, model, F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n))


def forecast_at(table: DataFrame, model: str, future: DataFrame) -> DataFrame:
    """Forecasts of the rows of ``future`` (client_id, ts) after a series' last
    value; only series with a fitted model have any (J5).  One row per series
    meets one row per series: the wanted hours are gathered first."""
    n = tasks(future.sparkSession, future.count())
    asked = future.repartition(n, CLIENT).groupBy(CLIENT).agg(F.collect_set(TS).alias("_asked"))
    rows = table.repartition(n, CLIENT).join(asked.hint("merge"), CLIENT)
    steps = F.filter(F.transform("_asked", lambda t: F.timestamp_diff("HOUR", F.col("last_ts"), t)), lambda k: k > 0)
    return _predictions(rows.withColumn("_steps", F.array_sort(steps)), model, F.col("_steps"))


def fitted(history: DataFrame, model: str) -> DataFrame:
    """one-step fitted values (model, client_id, ts, yhat); missing where the model has none."""
    name = REGISTRY[model]
    if name.fitted is None:
        table = fit(history, model)
        rows = table.where("status = 'ok'").join(history.select(CLIENT, F.col(TS).alias("_at")).distinct(), CLIENT)
        first = table.select("seasons").first()
        seasons = ast.literal_eval(first[0]) if first else ()
        return rows.select(MODEL, CLIENT, F.col("_at").alias(TS), additive.value(F.col("_at"), seasons).alias(YHAT))
    return name.fitted(history).select(F.lit(model).alias(MODEL), CLIENT, TS, YHAT)


def _moment(x) -> dt.datetime:
    return dt.datetime.fromisoformat(x) if isinstance(x, str) else x


def future_axis(history: DataFrame, hours: int | None = None, until=None) -> DataFrame:
    """per series the hours after its last history hour: ``hours`` of
    them (horizon by count, as the reference) or up to ``until`` (by span).
    Generated per series with ``sequence`` (no join)."""
    last = history.groupBy(CLIENT).agg(F.max(TS).alias("_last"))
    start = F.col("_last") + _hour()
    if until is not None:
        end = ntz_lit(until)
        earliest = last.agg(F.min("_last")).first()[0]
        hours = 0 if earliest is None else (_moment(until) - earliest).total_seconds() // 3600
    else:
        end = F.col("_last") + F.make_interval(hours=F.lit(int(hours)))
    return (spread(last, hours).where(end >= start)
            .select(CLIENT, F.explode(F.sequence(start, end, _hour())).alias(TS)))


def status_counts(table: DataFrame) -> DataFrame:
    """Series by (model, status): what was fitted and what was skipped."""
    return table.groupBy(MODEL, "status").agg(F.count("*").alias("series"))
