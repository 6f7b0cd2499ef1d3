"""Exponential smoothing (F1): additive forms with no, linear or damped trend,
with or without a season, chosen per series.

All rows of a parameter grid are states of one fold over the series' values:
a state holds the next forecast without its season, the damped slope and the
sum of squared one-step errors.  The season is kept by hour: an array of the
values of all rows of the grid for each hour of a period, so that an hour's step
puts one array in its place, whatever the number of rows.  Array functions are
interpreted, so what is known before (the coarse grid) stands in the steps as
numbers, and a row's season is put together only for the row that is chosen.
The best row of a coarse grid by AICc gives the form; a second fold over a
finer grid around its parameters gives the parameters.  The fold's last
state is what forecasts start from, so nothing has to be run again.

Starting states (Hyndman et al. 2008, heuristics): without a season the first
value and the first step; with one the mean of the first period, the change
of means from the first to the second period, and the first period's deviations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLIENT, TS, Y
from .arrays import let, let_all, mean, moved, series

NAME = "ets"


@dataclass(frozen=True)
class Settings:
    period: int = 24
    level: tuple = (0.1, 0.3, 0.6)                       # coarse grid
    slope: tuple = (0.05,)
    season: tuple = (0.1,)
    damping: tuple = (0.95,)
    finer_level: tuple = (0.35, 0.6, 1.0, 1.5)           # factors of the finer grid
    finer: tuple = (0.3, 1.0, 2.0)
    least: float = 1e-12                                 # mean squared error that counts as none


_FIELDS = ("trend", "seasonal", "a", "b", "c", "p", "k")


def grid(s: Settings) -> list[dict]:
    """Coarse grid: trend (0 none, 1 linear, 2 damped), season flag,
    parameters and their number; the slope's weight is at most the
    level's, the season's at most what the level's leaves."""
    out = []
    for seasonal in (0, 1):
        for trend in (0, 1, 2):
            for a in s.level:
                for b in s.slope if trend else (0.0,):
                    for p in s.damping if trend == 2 else (1.0,):
                        for c in s.season if seasonal else (0.0,):
                            if b <= a and c <= 1 - a:
                                k = 2 + 2 * (trend > 0) + (trend == 2) + s.period * seasonal
                                out.append({"trend": trend, "seasonal": seasonal, "a": a, "b": b, "c": c, "p": p, "k": k})
    return out


def _row(*values: Column) -> Column:
    """A row of the grid, with the two weights that a step needs."""
    named = dict(zip(_FIELDS, values, strict=True))
    return F.struct(*[named[x].alias(x) for x in _FIELDS], (named["a"] + named["p"] * named["b"]).alias("of_next"),
                    (named["p"] * named["b"]).alias("of_slope"))


def _start(q: Column, y: Column, first_mean: Column, step_of_means: Column, s: Settings) -> Column:
    level = F.when(q["seasonal"] == 1, first_mean).otherwise(y[0])
    slope = F.when(q["trend"] == 0, F.lit(0.0)).when(q["seasonal"] == 1, step_of_means) \
        .otherwise(F.when(F.size(y) > 1, F.get(y, F.lit(1)) - y[0]).otherwise(F.lit(0.0)))
    season = F.when(q["seasonal"] == 1, F.transform(F.slice(y, 1, s.period), lambda v: v - first_mean)) \
        .otherwise(F.array().cast("array<double>"))
    return F.struct((level + q["p"] * slope).alias("next"), (q["p"] * slope).alias("d"), season.alias("s"),
                    F.lit(0.0).alias("sse"))


def _advance(state: Column, q: Column, y: Column, seasonal: bool) -> Column:
    """The state after the value ``y``."""
    here = state["s"][0]
    error = y - state["next"] - here if seasonal else y - state["next"]
    season = F.concat(F.slice(state["s"], F.lit(2), F.size(state["s"])), F.array(here + q["c"] * error)) \
        if seasonal else state["s"]
    slope = q["p"] * state["d"]
    return F.struct((state["next"] + slope + q["of_next"] * error).alias("next"), (slope + q["of_slope"] * error).alias("d"),
                    season.alias("s"), (state["sse"] + error * error).alias("sse"))


def _coarse_start(rows: list[dict], y: Column, first: Column, step: Column) -> Column:
    """The states of ``rows``, whose parameters are numbers: an array for each part of the state."""
    size = F.size(y)
    own = F.when(size > 1, F.get(y, F.lit(1)) - y[0]).otherwise(F.lit(0.0))
    slopes = [(F.lit(float(q["p"])) * (step if q["seasonal"] else own)) if q["trend"] else F.lit(0.0) for q in rows]
    return F.struct(F.array(*[(first if q["seasonal"] else y[0]) + d for q, d in zip(rows, slopes, strict=True)]).alias("next"),
                    F.array(*slopes).alias("d"), F.array(*[F.lit(0.0) for _ in rows]).alias("sse"))


def _coarse_step(rows: list[dict], state: Column, error: Column) -> list[Column]:
    """:func:`_advance` of all ``rows`` by their errors, without the terms that are 0."""
    following, slopes = [], []
    for i, q in enumerate(rows):
        old, weight = state["d"][i], float(q["p"] * q["b"])
        damped = old if q["p"] == 1 else F.lit(float(q["p"])) * old
        level = state["next"][i] + damped if q["trend"] else state["next"][i]
        following.append(level + F.lit(float(q["a"] + weight)) * error[i])
        slopes.append(damped + F.lit(weight) * error[i] if q["trend"] else old)
    squares = [state["sse"][i] + error[i] * error[i] for i in range(len(rows))]
    return [F.array(*x).alias(name) for x, name in ((following, "next"), (slopes, "d"), (squares, "sse"))]


def _coarse_plain(rows: list[dict]) -> Column:
    """Sums of squared errors of the rows without season of the coarse grid."""
    def step(acc: Column, y: Column) -> Column:
        return moved(acc, F.transform(acc["next"], lambda x: y - x), lambda acc, e: F.struct(*_coarse_step(rows, acc, e)))

    return let_all([Y, "first_mean", "step_of_means"], lambda values, first, slope: F.aggregate(
        values, _coarse_start(rows, values, first, slope), step, lambda acc: acc["sse"]))


def _coarse_seasonal(rows: list[dict], s: Settings) -> Column:
    """Sums of squared errors of the rows with a season of the coarse grid."""
    def hour(acc: Column, h: Column) -> Column:
        errors = F.zip_with(acc["next"], h["season"], lambda x, here: h["y"] - x - here)
        return moved(acc, errors, lambda acc, e: F.struct(*_coarse_step(rows, acc, e), F.concat(acc["season"], F.array(F.array(
            *[h["season"][i] + F.lit(float(q["c"])) * e[i] for i, q in enumerate(rows)]))).alias("season")))

    def states(values: Column, first: Column, slope: Column) -> Column:
        season = F.transform(F.slice(values, 1, s.period), lambda v: F.array(*[v - first for _ in rows]))
        return _periods(values, _coarse_start(rows, values, first, slope), ("next", "d", "sse"), season, hour, s)["sse"]

    return let_all([Y, "first_mean", "step_of_means"], states)


def _periods(values: Column, start: Column, parts: tuple, season: Column, hour: Callable[[Column, Column], Column], s: Settings) -> Column:
    """Fold over ``values``, a period at a time.  ``hour(acc, h)`` is given the value h.y and the rows' values
    for its hour, h.season, and adds their new values at the end of acc.season."""
    of = lambda acc, season: F.struct(*[acc[x].alias(x) for x in parts], season.alias("season"))
    none = F.array().cast("array<array<double>>")

    def period(acc: Column, values: Column) -> Column:
        hours = F.zip_with(values, F.slice(acc["season"], F.lit(1), F.size(values)), lambda y, here: F.struct(
            y.alias("y"), here.alias("season")))
        rest = F.slice(acc["season"], F.size(values) + 1, F.lit(s.period))
        return F.aggregate(hours, of(acc, none), hour, lambda x: of(x, F.concat(rest, x["season"])))

    each = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(s.period)), lambda i: F.slice(values, i, F.lit(s.period)))
    return F.aggregate(each, of(start, season), period)


def _plain_states(rows: str, s: Settings) -> Column:
    """Last states of the rows of ``rows``, all without season."""
    return let_all([rows, Y, "first_mean", "step_of_means"], lambda rows, values, first, step: F.aggregate(
        values, F.transform(rows, lambda q: _start(q, values, first, step, s)),
        lambda acc, y: F.zip_with(acc, rows, lambda state, q: _advance(state, q, y, False))))


def _seasonal_states(rows: str, s: Settings) -> Column:
    """Last states of the rows of ``rows``, all with a season: ``state`` has one
    element a row, ``season`` an array of the rows' values for each hour of a
    period, the next hour first."""
    def one(state: Column, error: Column) -> Column:
        q = state["q"]
        slope = q["p"] * state["d"]
        return F.struct((state["next"] + slope + q["of_next"] * error).alias("next"), (slope + q["of_slope"] * error).alias("d"),
                        (state["sse"] + error * error).alias("sse"), (q["c"] * error).alias("change"), q.alias("q"))

    def hour(acc: Column, h: Column) -> Column:
        errors = F.zip_with(acc["state"], h["season"], lambda state, here: h["y"] - state["next"] - here)
        return moved(acc, F.zip_with(acc["state"], errors, one), lambda acc, state: F.struct(state.alias("state"), F.concat(
            acc["season"], F.array(F.zip_with(h["season"], state, lambda here, x: here + x["change"]))).alias("season")))

    def states(rows: Column, values: Column, first: Column, step: Column) -> Column:
        def start(q: Column) -> Column:
            slope = F.when(q["trend"] == 0, F.lit(0.0)).otherwise(q["p"] * step)
            return F.struct((first + slope).alias("next"), slope.alias("d"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("change"),
                            q.alias("q"))

        season = F.transform(F.slice(values, 1, s.period), lambda v: F.transform(rows, lambda q: v - first))
        return _periods(values, F.struct(F.transform(rows, start).alias("state")), ("state",), season, hour, s)

    return let_all([rows, Y, "first_mean", "step_of_means"], states)


def _best(df: DataFrame, s: Settings) -> DataFrame:
    """Columns ``best`` and ``row``: of the rows of a grid, ``rows``, the one whose sum of
    squared errors, in ``sse``, has the smallest AICc to 9 digits (the earlier one on ties)."""
    def score(rows: Column, n: Column, sse: Column, i: Column) -> Column:
        k = rows[i]["k"]
        free = n - k - 1
        value = n * F.ln(F.greatest(sse / n, F.lit(s.least))) + 2 * k + 2.0 * k * (k + 1) / F.greatest(free, F.lit(1))
        return F.struct((free <= 0).alias("not"), F.round(value, 9).alias("score"), i.alias("i"))

    return df.withColumn("best", F.array_min(let_all(["rows", "n"], lambda rows, n: F.transform(
        "sse", lambda sse, i: score(rows, n, sse, i))))).withColumn("row", F.col("rows")[F.col("best.i")])


def fit(history: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(client_id, last_ts, status, n, trend, seasonal, alpha, beta, gamma, phi, aicc, next,
    slope, season): one row per series; ``next`` is the next forecast without
    its season, ``slope`` what it holds of the damped slope.  A series without a value has
    status ``no values`` and no state."""
    return _chosen(series(history), settings).select(
        CLIENT, "last_ts", "status", "n", *[F.when(F.col("status") == "ok", F.col(c)).alias(name) for c, name in (
            ("row.trend", "trend"), ("row.seasonal", "seasonal"), ("row.a", "alpha"), ("row.b", "beta"), ("row.c", "gamma"),
            ("row.p", "phi"), ("best.score", "aicc"), ("state.next", "next"), ("state.d", "slope"), ("state.s", "season"))])


def _chosen(rows: DataFrame, s: Settings) -> DataFrame:
    second = F.slice(Y, s.period + 1, s.period)
    first = mean(F.slice(Y, 1, s.period))
    df = rows.withColumn("n", F.size(Y)).withColumn("status", F.when(F.col("n_values") > 0, "ok").otherwise("no values")) \
        .withColumn("first_mean", first) \
        .withColumn("step_of_means", F.when(F.size(second) > 0, (mean(second) - F.col("first_mean")) / s.period)
                    .otherwise(F.lit(0.0)))
    lit = lambda rows: F.array(*[_row(*[F.lit(r[x]) for x in _FIELDS]) for r in rows])
    plain, seasonal = ([r for r in grid(s) if r["seasonal"] == x] for x in (0, 1))
    with_season = F.when(F.col("n") >= 2 * s.period + 2, _coarse_seasonal(seasonal, s)).otherwise(F.array().cast("array<double>"))
    df = _best(df.withColumn("rows", lit(plain + seasonal)).withColumn("sse", F.concat(_coarse_plain(plain), with_season)), s)
    r = F.col("row")
    levels, factors, one = (F.array(*[F.lit(f) for f in x]) for x in (s.finer_level, s.finer, (1.0,)))
    around = let_all(["row"], lambda r: F.flatten(F.transform(levels, lambda fa: F.flatten(F.transform(
        F.when(r["trend"] > 0, factors).otherwise(one), lambda fb: F.transform(
            F.when(r["seasonal"] == 1, factors).otherwise(one), lambda fc: _finer(r, fa, fb, fc)))))))
    df = df.withColumn("rows", around).drop("best", "sse")
    df = df.withColumn("plain", F.when(r["seasonal"] == 0, _plain_states("rows", s))) \
        .withColumn("seasonal", F.when(r["seasonal"] == 1, _seasonal_states("rows", s))) \
        .withColumn("sse", F.coalesce(*[F.transform(c, lambda x: x["sse"]) for c in (F.col("plain"), F.col("seasonal.state"))]))
    df = _best(df, s)
    i = F.col("best.i")
    with_season = F.get(F.col("seasonal.state"), i)
    season = let(i, lambda i: F.transform(F.col("seasonal.season"), lambda x: x[i]))
    return df.withColumn("state", F.struct(
        *[F.coalesce(F.get("plain", i)[x], with_season[x]).alias(x) for x in ("next", "d")],
        F.when(F.col("seasonal").isNotNull(), season).otherwise(F.array().cast("array<double>")).alias("s"))) \
        .drop("rows", "sse", "plain", "seasonal")


def _finer(r: Column, fa: Column, fb: Column, fc: Column) -> Column:
    a = F.least(r["a"] * fa, F.lit(0.999))
    return _row(r["trend"], r["seasonal"], a, F.least(r["b"] * fb, a), F.least(r["c"] * fc, 1 - a), r["p"], r["k"])


def value(step: Column, period: int = 24) -> Column:
    """The forecast ``step`` hours after the last value, from the columns of :func:`fit`."""
    more = step - 1
    damped = F.try_divide(F.col("phi") * (1 - F.pow("phi", more)), 1 - F.col("phi"))
    run = F.when(F.col("trend") == 0, F.lit(0.0)).when(F.col("trend") == 1, more.cast("double")).otherwise(damped)
    season = F.when(F.col("seasonal") == 1, F.get("season", (more % period).cast("int"))).otherwise(F.lit(0.0))
    return F.col("next") + run * F.col("slope") + season


def fitted(history: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(client_id, ts, yhat): one-step fitted values."""
    df = _chosen(series(history), settings).where("status = 'ok'").withColumn("start", _start(F.col("row"), F.col(Y), F.col("first_mean"), F.col("step_of_means"), settings))

    def step(q: Column, acc: Column, y: Column) -> Column:
        state = acc["state"]
        here = F.when(q["seasonal"] == 1, F.get(state["s"], F.lit(0))).otherwise(F.lit(0.0))
        after = F.when(q["seasonal"] == 1, _advance(state, q, y, True)).otherwise(_advance(state, q, y, False))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(state["next"] + here)).alias("out"))

    run = let_all(["row"], lambda q: F.aggregate(
        F.col(Y), F.struct(F.col("start").alias("state"), F.array().cast("array<double>").alias("out")),
        lambda acc, y: step(q, acc, y), lambda acc: acc["out"]))
    return df.withColumn("out", run).select(CLIENT, F.explode(F.arrays_zip(TS, "out")).alias("r")) \
        .select(CLIENT, F.col(f"r.{TS}").alias(TS), F.col("r.out").alias("yhat"))
