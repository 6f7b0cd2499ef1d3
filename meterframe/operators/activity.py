"""Inactive-series detection and per-series diagnostics.

All figures refer to the *retained hour axis*: every hour from the first to
the last hour of the panel, minus removed days.  A missing hour counts as
zero (T5); a negative reading counts as non-zero.

Zero runs are computed without densifying the panel: every retained hour gets
a position ``pos`` in closed form (hours since the start minus 24 per removed
day before it), only non-zero hours are kept, and the longest run is the
largest gap between consecutive non-zero positions (or before the first /
after the last one).  The gaps are found inside bounded blocks of positions
first, then between consecutive blocks, so a hot series spreads over tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import date_text, ntz_lit, ts_text
from ..schema import CLIENT, TS, Y

POS_BLOCK = 24 * 28  # positions per block of the blocked lag (four weeks)


def position(ts_col, lo: dt.datetime, removed: list) -> F.Column:
    """Index of an hour on the retained axis starting at ``lo``.

    Removed days lie strictly after the first day (the first day is never a
    transition day), so each removed day before ``ts`` is a whole 24 hours."""
    t = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    hours = F.timestamp_diff("HOUR", ntz_lit(lo), t)
    day = F.to_date(t)
    before = F.lit(0)
    for d in removed:
        before = before + F.when(day > F.lit(d).cast("date"), 24).otherwise(0)
    return (hours - before).cast("long")


def axis_length(lo: dt.datetime, hi: dt.datetime, removed: list) -> int:
    """Number of retained hours between ``lo`` and ``hi`` (inclusive)."""
    total = int((hi - lo).total_seconds() // 3600) + 1
    lo_d, hi_d = lo.date(), hi.date()
    for d in removed:
        if lo_d < d < hi_d:
            total -= 24
        elif d == hi_d and d != lo_d:
            total -= hi.hour + 1
    return total


def activity_stats(hourly: DataFrame, clients: DataFrame, lo: dt.datetime,
                   hi: dt.datetime, removed: list, rate_min: float,
                   run_max: int) -> DataFrame:
    """A5-A7, A9 per series.

    ``hourly``: retained hourly panel (removed days already dropped).
    ``clients``: every series of the wide table (``client_id``), including
    series without any non-zero reading.
    Output: ``client_id, nonzero_hours, nonzero_rate, max_zero_run,
    first_nonzero_ts, active``.
    """
    n = axis_length(lo, hi, removed)
    nz = (hourly.where(F.col(Y).isNotNull() & (F.col(Y) != 0))
          .select(CLIENT, TS, position(TS, lo, removed).alias("pos"))
          .withColumn("_blk", F.floor(F.col("pos") / POS_BLOCK)))
    # gaps inside a (series, block): bounded groups, one exchange; the block
    # summary then reuses that partitioning
    w_in = Window.partitionBy(CLIENT, "_blk").orderBy("pos")
    blocks = (nz.withColumn("_gap", F.col("pos") - F.lag("pos").over(w_in) - 1)
              .groupBy(CLIENT, "_blk")
              .agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"),
                   F.max("_gap").alias("_inner"), F.count(F.lit(1)).alias("_n"),
                   F.min(TS).alias("_ts")))
    # gaps between consecutive non-empty blocks: one row per block, one
    # exchange by series; the per-series aggregate reuses it
    w_blk = Window.partitionBy(CLIENT).orderBy("_blk")
    per = (blocks.withColumn("_cross", F.col("_first")
                             - F.coalesce(F.lag("_last").over(w_blk), F.lit(-1)) - 1)
           .groupBy(CLIENT)
           .agg(F.sum("_n").alias("nonzero_hours"),
                F.greatest(F.max("_inner"), F.max("_cross")).alias("inner_run"),
                F.max("_last").alias("last_pos"),
                F.min("_ts").alias("first_nonzero_ts")))
    out = (clients.select(CLIENT).distinct().join(per, CLIENT, "left")
           .select(
               CLIENT,
               F.coalesce("nonzero_hours", F.lit(0)).cast("long").alias("nonzero_hours"),
               (F.coalesce("nonzero_hours", F.lit(0)) / F.lit(float(n))).alias("nonzero_rate"),
               F.when(F.col("nonzero_hours").isNull(), F.lit(n))
                .otherwise(F.greatest("inner_run", F.lit(n - 1) - F.col("last_pos")))
                .cast("long").alias("max_zero_run"),
               "first_nonzero_ts"))
    active = (F.col("nonzero_rate") >= F.lit(rate_min)) & (F.col("max_zero_run") <= F.lit(run_max))
    return out.withColumn("active", active)


def active_clients(stats: DataFrame) -> DataFrame:
    """A7 keep-list (``client_id``), for semi joins."""
    return stats.where("active").select(CLIENT)


def first_nonzero_text(stats: DataFrame) -> DataFrame:
    """A9 as the reference reports it: ``YYYY-MM-DD HH:MM:SS`` or NULL."""
    return stats.select(CLIENT, ts_text("first_nonzero_ts").alias("first_nonzero"))


def incomplete_days(spine: DataFrame, expected: int = 24) -> DataFrame:
    """Retained days whose number of hours differs from ``expected``."""
    return (spine.groupBy(F.to_date(TS).alias("day"))
            .agg(F.count(F.lit(1)).alias("hours"))
            .where(F.col("hours") != expected)
            .select(date_text("day").alias("date"), F.col("hours").cast("long").alias("hours")))
