"""Integrity report of a readings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefns import ts_text
from ..schema import CLIENT, TS
from ..session import stored
from .ordered import previous_in_order

DAY_MICROS = 86_400 * 1_000_000


def epoch_micros(col: str = TS) -> F.Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, without any time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                           F.col(col))


def irregular_steps(axis: DataFrame, step_seconds: int, ts: str = TS) -> DataFrame:
    """W1 on the distinct time axis: one row per consecutive pair whose step
    differs from ``step_seconds``.  The lag is blocked by day, so the axis is
    never gathered into one task.  Output: ``ts, prev_ts, step_seconds``."""
    x = axis.select(ts).distinct().withColumn("_us", epoch_micros(ts))
    x = previous_in_order(x, [], "_us", DAY_MICROS, out="_prev")
    return (x.where(F.col("_prev").isNotNull()
                    & ((F.col("_us") - F.col("_prev")) != F.lit(step_seconds * 1_000_000)))
            .select(ts,
                    F.timestamp_add("MICROSECOND", F.col("_prev") - F.col("_us"), F.col(ts)).alias("prev_ts"),
                    ((F.col("_us") - F.col("_prev")) / 1e6).alias("step_seconds")))


def integrity_report(readings: DataFrame, step_seconds: int = 900,
                     raw: DataFrame | None = None) -> DataFrame:
    """A4 as one row.

    ``rows`` counts distinct timestamps (rows of the wide table), ``clients``
    distinct series.  ``duplicate_timestamps`` is counted on the time axis after
    duplicates were averaged, like the reference, so it is 0;
    ``raw_duplicate_readings`` is ours and counts extra readings of a (series,
    timestamp) in ``raw``.  The readings are read twice: for their
    (series, time) pairs, and for their series.
    """
    source = readings if raw is None else raw              # averaging duplicates keeps the (series, time) pairs
    keys = source.groupBy(CLIENT, TS).agg(F.count(F.lit(1)).alias("n"))
    # one row per timestamp, read by all figures but the number of series
    axis = stored(keys.groupBy(TS).agg(F.sum(F.col("n") - 1).alias("extra")), "axis")
    bounds = axis.agg(F.count(F.lit(1)).alias("rows"), F.min(TS).alias("lo"), F.max(TS).alias("hi"),
                      (F.count(F.lit(1)) - F.count_distinct(TS)).alias("duplicates"),
                      F.coalesce(F.sum("extra"), F.lit(0)).alias("raw_duplicate_readings"))
    n_clients = source.agg(F.count_distinct(CLIENT).alias("clients"))
    irregular = irregular_steps(axis, step_seconds).agg(
        F.count(F.lit(1)).alias("non_step_intervals"))
    # one-row aggregates combined by a union and one global aggregate
    # (no join, hence no cartesian product in the plan)
    parts = [bounds, n_clients, irregular]
    rep = parts[0]
    for d in parts[1:]:
        rep = rep.unionByName(d, allowMissingColumns=True)
    cols = ["rows", "lo", "hi", "clients", "duplicates", "non_step_intervals", "raw_duplicate_readings"]
    rep = rep.agg(*[F.max(c).alias(c) for c in cols])
    return rep.select(
        F.col("rows").cast("long").alias("rows"),
        F.col("clients").cast("long").alias("clients"),
        ts_text("lo").alias("start"),
        ts_text("hi").alias("end"),
        F.col("duplicates").cast("long").alias("duplicate_timestamps"),
        F.col("non_step_intervals").cast("long").alias("non_15m_intervals"),
        F.col("raw_duplicate_readings").cast("long").alias("raw_duplicate_readings"))
