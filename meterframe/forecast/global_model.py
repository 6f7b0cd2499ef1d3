"""One pooled model over all series (F10), its rolling use (F9) and the
in-sample proxy (F11).

Re-aims the reference's global neural model as a pooled linear model on
per-series standard-scaled values: input window ``input_size`` hours, output
chunk ``chunk`` hours.  For a target hour ``t`` of a chunk starting at origin
``o`` the features come from the input window ``[o - input_size, o)`` only:

* mean scaled value of the window at the hour of week of ``t``,
* mean scaled value of the window at the hour of day of ``t``,
* mean scaled value of the last 24 hours of the window,
* the seven calendar columns of ``t`` and a bias.

Training origins step back from each series' end by ``chunk`` hours, so every
history row is a target once.  Windows are unions of whole pieces of time
(a chunk cut where windows end), so the history is first summed by (series,
piece, hour of week).  Only these sums, at most 168 for a piece, go to the
windows that hold the piece; no row is repeated however much windows overlap.
The fit sums X'X and X'y in one distributed aggregate; a system of 11 unknowns
is left.

A forecast is a fold over rounds on one row per series: the window's values by
hour, the means of its slots, the next chunk, the window moved on.  So a
rolling forecast is a single job, each series advancing by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import CALENDAR_COLS, calendar_columns
from ..functions.numeric import nan_to_null
from ..functions.timefns import ntz_lit
from ..operators import panel
from ..operators.partitioning import by_series, matched
from ..schema import CLIENT, MODEL, PREDICTIONS, TS, Y, YHAT
from ..sources.sinks import stored
from .arrays import let, let_all, moments, solve, system, triangle

FEATURES = ["f_how", "f_hod", "f_lvl", *CALENDAR_COLS, "bias"]
NAME = "global_linear"
WEEK = 168


def _how(ts: Column) -> Column:
    return (F.weekday(ts) * 24 + F.hour(ts)).cast("int")


def _rows(history: DataFrame) -> DataFrame:
    return history.where(F.col(CLIENT).isNotNull() & F.col(TS).isNotNull()) \
        .select(CLIENT, TS, nan_to_null(F.col(Y).cast("double")).alias(Y))


def _scale(n: Column, s: Column, ss: Column) -> Column:
    """Standard deviation from sums; 1 where it is nothing but rounding."""
    var = ss / n - (s / n) * (s / n)
    return F.when(var > 1e-12 * ss / n, F.sqrt(var)).otherwise(F.lit(1.0))


def _dense(entries: Column, size: int) -> Column:
    """Array of ``size`` values from (place, value) pairs, missing elsewhere."""
    none = F.lit(None).cast("double")
    filled = F.aggregate(F.array_sort(entries), F.array().cast("array<double>"), lambda acc, e: F.concat(
        acc, F.array_repeat(none, e["place"] - F.size(acc)), F.array(e["value"])))
    return let(filled, lambda x: F.concat(x, F.array_repeat(none, F.lit(size) - F.size(x))))


def window_sums(history: DataFrame, input_size: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(targets, windows): every row with a value as the target of its origin
    ``k``, and one row per (series, origin): sums of the input window, and the
    means by hour of week and hour of day as arrays."""
    rows = by_series(_rows(history))
    ends = rows.groupBy(CLIENT).agg(F.max(TS).alias("_end"))
    rows = rows.join(ends, CLIENT).withColumn("_g", F.timestamp_diff("HOUR", F.col(TS), F.col("_end")))
    whole, rest = divmod(input_size, chunk)
    into = F.col("_g") % chunk
    side = F.when(into < rest, 0).otherwise(1)            # the part of a chunk that still is in the window, or not
    rows = rows.where(F.col(Y).isNotNull()).withColumn("_q", F.floor(F.col("_g") / chunk).cast("long"))
    pieces = rows.groupBy(CLIENT, "_q", side.alias("_side"), _how(F.col(TS)).alias("slot")).agg(
        F.count(Y).alias("n"), F.sum(Y).alias("s"), F.sum(F.col(Y) * F.col(Y)).alias("ss"),
        F.sum(F.when(into < 24, F.col(Y))).alias("ls"), F.count(F.when(into < 24, F.col(Y))).alias("ln"))
    first = F.greatest(F.col("_q") - whole + F.col("_side"), F.lit(1))
    of_origin = pieces.where(first <= F.col("_q")).select("*", F.explode(F.sequence(first, F.col("_q"))).alias("k"))
    newest = lambda c: F.sum(F.when(F.col("k") == F.col("_q"), F.col(c)))
    slots = of_origin.groupBy(CLIENT, "k", "slot").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), newest("ls").alias("ls"), newest("ln").alias("ln"))
    by_slot = F.collect_list(F.struct(F.col("slot").alias("place"), (F.col("s") / F.col("n")).alias("value")))
    windows = slots.groupBy(CLIENT, "k").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("ls").alias("ls"), F.sum("ln").alias("ln"),
        by_slot.alias("by_slot"), F.collect_list(F.struct("slot", "n", "s")).alias("sums"))
    hod = let_all(["sums"], lambda sums: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: let(
        F.filter(sums, lambda x: x["slot"] % 24 == h), lambda x: F.try_divide(
            F.aggregate(x, F.lit(0.0), lambda a, e: a + e["s"]), F.aggregate(x, F.lit(0.0), lambda a, e: a + e["n"])))))
    windows = windows.select(CLIENT, "k", "n", (F.col("s") / F.col("n")).alias("mu"),
                             _scale(F.col("n"), F.col("s"), F.col("ss")).alias("sd"),
                             F.try_divide("ls", "ln").alias("level"), _dense(F.col("by_slot"), WEEK).alias("how"), hod.alias("hod"))
    return rows.select(CLIENT, (F.col("_q") + 1).alias("k"), TS, Y), windows


def training_rows(history: DataFrame, input_size: int = 672, chunk: int = 720) -> DataFrame:
    """Every history row with a value: its scaled value ``_z`` and the features;
    both are missing for the rows whose origin has no input window."""
    targets, windows = window_sums(history, input_size, chunk)
    f = matched(targets, windows, [CLIENT, "k"], "left", counted=history)
    z = lambda c: F.when(F.col("n") > 0, F.coalesce((c - F.col("mu")) / F.col("sd"), F.lit(0.0)))
    slot = _how(F.col(TS))
    cal = calendar_columns(TS)
    return f.select(CLIENT, "k", TS, Y, "n", F.col("mu").alias("_mu"), ((F.col(Y) - F.col("mu")) / F.col("sd")).alias("_z"),
                    z(F.get("how", slot)).alias("f_how"), z(F.get("hod", slot % 24)).alias("f_hod"), z(F.col("level")).alias("f_lvl"),
                    *[cal[c].cast("double").alias(c) for c in CALENDAR_COLS], F.lit(1.0).alias("bias"))


def moment_row(history: DataFrame, input_size: int = 672, chunk: int = 720) -> DataFrame:
    """One row: ``sums`` (upper triangle of X'X row by row, then X'y), ``rows``
    used, and the rows without an input window (``short``)."""
    rows = training_rows(history, input_size, chunk)
    return rows.agg(F.array(*[F.coalesce(m, F.lit(0.0)) for m in moments([F.col(c) for c in FEATURES], F.col("_z"))]).alias("sums"),
                    F.count("_z").alias("rows"), F.count_if(F.col("_z").isNull()).alias("short"))


def fit(history: DataFrame, input_size: int = 672, chunk: int = 720, ridge: float = 1e-3) -> list[float]:
    """Pooled least squares on scaled values; returns the weight vector."""
    n = len(FEATURES)
    r = moment_row(history, input_size, chunk).select(
        solve(system(F.col("sums"), n, [ridge] * n)).alias("w"), "rows", "short").first()
    if r is None or not r["rows"]:
        raise ValueError(f"no training rows: none of the {r['short'] if r else 0} rows lies a whole chunk of {chunk} hours after "
                         f"the start of its series (lower input_size / chunk)")
    return list(r["w"])


def last_windows(history: DataFrame, input_size: int) -> DataFrame:
    """(client_id, end, w): per series the last hour and the values of the
    last ``input_size`` hours, the oldest first, missing where there are none."""
    rows = by_series(_rows(history))
    ends = rows.groupBy(CLIENT).agg(F.max(TS).alias("end"))
    rows = rows.join(ends, CLIENT).withColumn(
        "place", (input_size - 1 - F.timestamp_diff("HOUR", F.col(TS), F.col("end"))).cast("int")).where("place >= 0")
    got = rows.groupBy(CLIENT, "end").agg(F.collect_list(
        F.when(F.col(Y).isNotNull(), F.struct("place", F.col(Y).alias("value")))).alias("e"))
    return got.select(CLIENT, "end", _dense(F.col("e"), input_size).alias("w"))


def _mean_at(w: Column, first: Column, step: int, size: int) -> Column:
    """Mean of the values at places first, first + step, ..."""
    places = F.sequence(first, F.greatest(first, F.lit(size - 1)), F.lit(step))
    got = F.filter(F.transform(places, lambda j: F.get(w, j)), lambda v: v.isNotNull())
    return let(got, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v)))


def _next_chunk(weights: list[float], w: Column, end: Column, input_size: int, chunk: int) -> Column:
    """The forecasts of the ``chunk`` hours after ``end``, given the window ``w``."""
    last = input_size - 1
    known = F.filter(w, lambda v: v.isNotNull())
    size = input_size
    day = F.filter(F.slice(w, F.lit(max(1, size - 23)), F.lit(24)), lambda v: v.isNotNull())
    add = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))

    def with_base(base: Column) -> Column:
        # slot of place j is base - (last - j), modulo the week
        how = F.transform(F.sequence(F.lit(0), F.lit(WEEK - 1)), lambda s: _mean_at(w, F.pmod(s - base + last, F.lit(WEEK)), WEEK, size))
        hod = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: _mean_at(w, F.pmod(h - base + last, F.lit(24)), 24, size))
        sums = let(known, lambda v: F.struct(F.size(v).cast("double").alias("n"), add(v, lambda x: x).alias("s"),
                                             add(v, lambda x: x * x).alias("ss")))
        level = let(day, lambda v: F.try_divide(add(v, lambda x: x), F.size(v)))
        stats = let(sums, lambda q: F.struct(q["n"].alias("n"), F.try_divide(q["s"], q["n"]).alias("mu"),
                                             F.when(q["n"] > 0, _scale(q["n"], q["s"], q["ss"])).alias("sd"), level.alias("level"),
                                             how.alias("how"), hod.alias("hod")))

        def with_stats(q: Column) -> Column:
            z = lambda c: F.coalesce((c - q["mu"]) / q["sd"], F.lit(0.0))

            def at(i: Column) -> Column:
                ts, slot = end + F.make_interval(hours=i), F.pmod(base + i, F.lit(WEEK))
                cal = calendar_columns(ts)
                terms = [z(q["how"][slot]), z(q["hod"][slot % 24]), z(q["level"]), *[cal[c].cast("double") for c in CALENDAR_COLS],
                         F.lit(1.0)]
                return q["mu"] + q["sd"] * sum((F.lit(float(x)) * t for x, t in zip(weights, terms, strict=True)), F.lit(0.0))

            return F.transform(F.sequence(F.lit(1), F.lit(chunk)), at)

        return let(stats, with_stats)

    return let(_how(end), with_base)


def _rounds(weights: list[float], windows: DataFrame, rounds: Column, input_size: int, chunk: int) -> DataFrame:
    """(client_id, ts, yhat): ``rounds`` chunks for every series, each from the
    window that the chunks before it have moved on."""
    def step(acc: Column, _: Column) -> Column:
        got = _next_chunk(weights, acc["w"], acc["end"], input_size, chunk)
        return let(got, lambda new: F.struct(
            F.slice(F.concat(acc["w"], F.transform(new, lambda v: v.cast("float").cast("double"))), F.lit(chunk + 1),
                    F.lit(input_size)).alias("w"),
            (acc["end"] + F.make_interval(hours=F.lit(chunk))).alias("end"), F.concat(acc["out"], new).alias("out")))

    out = F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))),
                      F.struct(F.col("w"), F.col("end"), F.array().cast("array<double>").alias("out")), step, lambda acc: acc["out"])
    got = windows.where(rounds > 0).withColumn("_out", out).select(CLIENT, "end", F.posexplode("_out").alias("_i", YHAT))
    return got.where(F.col(YHAT).isNotNull()) \
        .select(F.lit(NAME).alias(MODEL), CLIENT, (F.col("end") + F.make_interval(hours=F.col("_i") + 1)).alias(TS), YHAT)


def predict(weights, history: DataFrame, hours: int, input_size: int = 672) -> DataFrame:
    """Forecasts of the ``hours`` hours after each series' history, from its
    last ``input_size`` hours."""
    return _rounds(list(weights), last_windows(history, input_size), F.lit(1), input_size, hours)


def rolling_forecast(weights, history: DataFrame, wanted: DataFrame, input_size: int = 672,
                     chunk: int = 720, variant: str = "remaining") -> DataFrame:
    """predict ``chunk`` hours from the last ``input_size`` hours, extend the
    history, repeat; the wanted hours are kept.

    ``wanted`` holds (client_id, ts) pairs, or timestamps wanted of every
    series.  With ``variant="remaining"`` (default) every series advances from
    its own last hour to its own last wanted hour, so gaps among the wanted
    hours and series of different length lose nothing.  All its rounds are one
    fold on the series' row.  Series without history have no forecast (J5),
    and hours that are not after a series' history none either.
    ``variant="chunks"`` is the notebook loop: the wanted timestamps are cut
    into ceil(h / chunk) slices in order (W5); round i keeps predictions of
    slice i only and appends only those, so a removed day loses hours (T8).
    Its rounds are jobs of their own, the shortened history written between."""
    weights, keys = list(weights), [c for c in (CLIENT, TS) if c in wanted.columns]
    keep = stored(wanted.select(*keys).distinct(), "wanted")
    if variant == "chunks":
        return _by_slices(weights, history, keep, input_size, chunk)
    windows = last_windows(history, input_size)
    if CLIENT in keys:
        windows = windows.join(keep.groupBy(CLIENT).agg(F.max(TS).alias("_last")), CLIENT)
    else:
        windows = windows.withColumn("_last", ntz_lit(keep.agg(F.max(TS)).first()[0]))
    rounds = F.ceil(F.timestamp_diff("HOUR", F.col("end"), F.col("_last")) / chunk).cast("int")
    got = _rounds(weights, windows, F.coalesce(rounds, F.lit(0)), input_size, chunk)
    if CLIENT not in keys:
        return got.join(keep, keys, "left_semi").select(*[f.name for f in PREDICTIONS.fields])
    return matched(got, keep, keys, "left_semi", counted=keep).select(*[f.name for f in PREDICTIONS.fields])


def _by_slices(weights: list[float], history: DataFrame, keep: DataFrame, input_size: int, chunk: int) -> DataFrame:
    cols = [f.name for f in PREDICTIONS.fields]
    hist = stored(panel.lookback(history.select(CLIENT, TS, Y), input_size), "rolling")
    slices = stored(panel.chunk_index(keep.select(TS).distinct(), chunk), "slices")
    rounds = (slices.agg(F.max("chunk")).first()[0] or 0) + 1
    out = history.sparkSession.createDataFrame([], PREDICTIONS)
    for i in range(rounds):
        got = predict(weights, hist, chunk, input_size)
        got = stored(got.join(slices.where(F.col("chunk") == i).select(TS), TS, "left_semi"), "rolling")
        out = out.unionByName(got.select(*cols))
        if i + 1 < rounds:
            more = got.select(CLIENT, TS, F.col(YHAT).cast("float").alias(Y))
            hist = stored(panel.lookback(hist.unionByName(more), input_size), "rolling")
    return out


def in_sample_proxy(weights, train: DataFrame, n: int, input_size: int = 672,
                    chunk: int = 720) -> DataFrame:
    """hide the last ``n`` hours of train (cutoff = smallest per-series
    n-th last timestamp, A18), predict them, return scored pairs
    ``client_id, ts, y, yhat``."""
    cutoff = panel.in_sample_cutoff(by_series(train), n).first()["cutoff"]
    hist, hidden = panel.split_at(train, cutoff)
    preds = rolling_forecast(weights, hist, hidden.select(CLIENT, TS), input_size, chunk)
    return matched(hidden.select(CLIENT, TS, Y), preds.select(CLIENT, TS, YHAT), [CLIENT, TS])
