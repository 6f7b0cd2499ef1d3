"""Additive model (F4): piecewise linear trend, daily, weekly and yearly
Fourier terms and a weekend effect, fitted per series over its whole history.

The normal equations of all series come from one grouped aggregate.  Between
two changepoints the trend's columns are linear in time, so it is enough to sum
the products of the plain columns per (series, segment).  The sums of a hinge,
max(t - c, 0), are those of all segments from its changepoint on, of t less c;
they are put together from suffix sums of at most ``changepoints + 1``
rows.  The ridge system is solved by elimination on arrays.

Time runs from 0 to 1 over a series' own history.  Changepoints are evenly
spaced in its first 80 %.  Seasons whose two periods do not fit into the history
of the panel are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..functions.timefns import weekday0
from ..operators.partitioning import by_series
from ..operators.resample import time_bounds
from ..schema import CLIENT, TS, Y
from .arrays import let_all, solve, triangle

NAME = "additive"
#: Period in hours and number of harmonics of the seasons.
SEASONS = ((24.0, 4), (168.0, 3), (365.25 * 24, 10))


@dataclass(frozen=True)
class Settings:
    changepoints: int = 25
    trend_range: float = 0.8
    seasons: tuple = SEASONS
    trend_penalty: float = 10.0
    season_penalty: float = 0.1


def hours(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp")) / 3600.0


def seasonal_columns(ts: Column, seasons) -> list[Column]:
    """Sine and cosine of every harmonic, then the weekend flag."""
    out = []
    for period, order in seasons:
        for k in range(1, order + 1):
            angle = hours(ts) * (2 * k) * F.pi() / period
            out += [F.sin(angle), F.cos(angle)]
    return [*out, (weekday0(ts) >= 5).cast("double")]


def seasons_of(history: DataFrame, settings: Settings) -> tuple:
    """Seasons with two periods in the panel's history (one small action)."""
    lo, hi = time_bounds(history)
    span = (hi - lo).total_seconds() / 3600 + 1
    return tuple((p, k) for p, k in settings.seasons if 2 * p <= span)


def fit(history: DataFrame, settings: Settings = Settings(), seasons: tuple | None = None) -> DataFrame:
    """(client_id, last_ts, status, first_hour, span_hours, seasons, beta): beta holds
    level, slope, changes of slope, seasonal terms and weekend.  A series
    without a value has status ``no values`` and no beta."""
    seasons = seasons_of(history, settings) if seasons is None else seasons
    n_cp = settings.changepoints
    gap = settings.trend_range / (n_cp + 1)
    whole = Window.partitionBy(CLIENT)
    h = hours(F.col(TS))
    rows = by_series(history.where(F.col(CLIENT).isNotNull() & F.col(TS).isNotNull())) \
        .select(CLIENT, TS, nan_to_null(F.col(Y).cast("double")).alias("v"), h.alias("h")) \
        .select("*", F.min("h").over(whole).alias("first_hour"),
                F.greatest(F.max("h").over(whole) - F.min("h").over(whole), F.lit(1.0)).alias("span_hours"),
                F.max(TS).over(whole).alias("last_ts"))
    t = (F.col("h") - F.col("first_hour")) / F.col("span_hours")
    plain = [F.lit(1.0), F.col("t"), *[F.col(f"s{i}") for i in range(sum(2 * k for _, k in seasons) + 1)]]
    n = len(plain)
    rows = rows.select("*", t.alias("t"), *[c.alias(f"s{i}") for i, c in enumerate(seasonal_columns(F.col(TS), seasons))]) \
        .withColumn("segment", F.least(F.floor(F.col("t") / gap), F.lit(n_cp)).cast("int"))
    v = F.col("v")
    # one row of the products at a time: an aggregate of all of them at once is too long for the JVM to compile
    by = [CLIENT, "segment", "last_ts", "first_hour", "span_hours"]
    rows = rows.select(*by, "v", *[c for c in ("t", *[f"s{i}" for i in range(n - 2)])], F.posexplode(F.array(*plain)).alias("i", "a"))
    a = F.when(v.isNotNull(), F.col("a"))
    of_column = rows.groupBy(*by, "i").agg(F.count("v").alias("n"), F.coalesce(F.sum(a * v), F.lit(0.0)).alias("y"),
                                           F.array(*[F.coalesce(F.sum(a * c), F.lit(0.0)) for c in plain]).alias("p"))
    per_segment = of_column.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "p", "y"))).alias("r")) \
        .withColumn("sums", F.concat(F.flatten(F.transform("r", lambda x: F.slice(x["p"], x["i"] + 1, F.lit(n)))), F.col("r")["y"]))
    per_series = per_segment.groupBy(CLIENT, "last_ts", "first_hour", "span_hours") \
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("segment", "sums")).alias("segments"))

    # sums over all segments from each one on
    size = len(triangle(n)) + n
    zeros = F.array_repeat(F.lit(0.0), size)
    suffix = let_all(["segments"], lambda segments: F.aggregate(
        F.sequence(F.lit(n_cp), F.lit(0)), F.array(zeros), lambda near, s: F.concat(F.array(F.aggregate(
            F.filter(segments, lambda x: x["segment"] == s), near[0], lambda a, x: F.zip_with(a, x["sums"], lambda p, q: p + q))), near)))
    at = {}
    for k, (i, j) in enumerate(triangle(n)):
        at[i, j] = at[j, i] = k
    place = F.array(*[F.array(*[F.lit(at[i, j]) for j in range(n)]) for i in range(n)])
    # the model's columns: plain column a from segment s on, plus h times the constant column, with penalty r
    columns = [(0, 0, 0.0, 1e-9), (1, 0, 0.0, 1e-9)] + \
        [(1, j, -gap * j, settings.trend_penalty) for j in range(1, n_cp + 1)] + \
        [(a, 0, 0.0, settings.season_penalty) for a in range(2, n - 1)] + [(n - 1, 0, 0.0, 1e-9)]
    cols = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(s).alias("s"), F.lit(float(x)).alias("h"), F.lit(r).alias("r"))
                     for a, s, x, r in columns])
    m = len(triangle(n))

    def entry(near: Column, place: Column, c: Column, d: Column) -> Column:
        sums = near[F.greatest(c["s"], d["s"])]
        return sums[place[c["a"]][d["a"]]] + d["h"] * sums[place[c["a"]][0]] \
            + c["h"] * sums[place[0][d["a"]]] + c["h"] * d["h"] * sums[0]

    def right(near: Column, c: Column) -> Column:
        sums = near[c["s"]]
        return sums[F.lit(m) + c["a"]] + c["h"] * sums[m]

    rows_of = let_all(["suffix", "place", "cols"], lambda near, place, cols: F.transform(cols, lambda c, i: F.concat(
        F.transform(cols, lambda d, j: entry(near, place, c, d) + F.when(i == j, c["r"]).otherwise(F.lit(0.0))),
        F.array(right(near, c)))))
    found = per_series.withColumn("suffix", suffix).withColumn("place", place).withColumn("cols", cols) \
        .withColumn("rows", rows_of)
    return found.select(
        CLIENT, "last_ts", F.when(F.col("n") > 0, "ok").otherwise("no values").alias("status"), "first_hour", "span_hours",
        F.lit(repr(seasons)).alias("seasons"), F.when(F.col("n") > 0, solve(F.col("rows"))).alias("beta"))


def value(ts: Column, seasons: tuple, settings: Settings = Settings()) -> Column:
    """The model at ``ts``, from the columns of :func:`fit`."""
    t = (hours(ts) - F.col("first_hour")) / F.col("span_hours")
    gap = settings.trend_range / (settings.changepoints + 1)
    columns = [F.lit(1.0), t, *[F.greatest(t - gap * j, F.lit(0.0)) for j in range(1, settings.changepoints + 1)],
               *seasonal_columns(ts, seasons)]
    return sum((F.col("beta")[i] * c for i, c in enumerate(columns[1:], 1)), F.col("beta")[0])
