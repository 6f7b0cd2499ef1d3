"""Daylight-saving transition days: detection, artefact snapshot, removal
(W2, X5, A11, P3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import date_text, utc_offset_seconds
from ..schema import TS, Y


def transition_dates(spark: SparkSession, lo_day, hi_day, tz: str) -> DataFrame:
    """Days whose UTC offset at local noon differs from the previous
    day's; the first day of the range is never flagged.

    No window: each day compares its own noon with the previous day's noon,
    so the day list is a plain generated column.  Returns ``day DATE``.
    """
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(lo_day).cast("date"), F.lit(hi_day).cast("date"))).alias("day"))
    noon = F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    prev_noon = noon - F.expr("INTERVAL 1 DAY")
    return (days.where(F.col("day") > F.lit(lo_day).cast("date"))
            .where(utc_offset_seconds(noon, tz) != utc_offset_seconds(prev_noon, tz))
            .select("day"))


def transition_dates_for(df: DataFrame, tz: str, ts: str = TS, bounds=None) -> list[dt.date]:
    """Transition days inside the time range of ``df`` (or of ``bounds``), as
    a small Python list (at most two per year, so collecting it is bounded)."""
    if bounds is None:
        row = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        if row is None or row["lo"] is None:
            raise ValueError("empty input: no timestamps")
        bounds = (row["lo"], row["hi"])
    days = transition_dates(df.sparkSession, bounds[0].date(), bounds[1].date(), tz)
    return sorted(r["day"] for r in days.collect())


def dates_frame(spark: SparkSession, dates: list) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "day date")


def drop_days(df: DataFrame, dates: list, ts: str = TS) -> DataFrame:
    """Remove every row whose calendar day is in ``dates``.

    ``dates`` are transition days (two per year at most), so the literal
    ``NOT IN`` list is bounded and the filter stays a narrow projection."""
    if not dates:
        return df
    return df.where(~F.to_date(F.col(ts)).isin([F.lit(d).cast("date") for d in dates]))


def artefact_snapshot(readings: DataFrame, dates: list, n_clients: int,
                      slot_start_h: int = 1, slot_end_h: int = 2) -> DataFrame:
    """For each transition day, the timestamps of the shared axis within
    ``[day + slot_start_h, day + slot_end_h)`` and the share of them at which
    every series reads exactly 0.  A missing reading is *not* zero here (T5).
    A day without timestamps in the slot gives 0.0 / 0.0.

    ``readings`` are de-duplicated (one row per series and timestamp);
    ``n_clients`` is the number of series of the wide table.
    Output: ``date STRING, rows_01_to_02 DOUBLE, all_client_zero_row_rate DOUBLE``.
    """
    spark = readings.sparkSession
    days = dates_frame(spark, dates)
    if not dates:
        return days.select(date_text("day").alias("date"),
                           F.lit(0.0).alias("rows_01_to_02"),
                           F.lit(0.0).alias("all_client_zero_row_rate"))
    day = F.to_date(F.col(TS))
    in_slot = (day.isin([F.lit(d).cast("date") for d in dates])
               & (F.col(TS) >= day.cast("timestamp_ntz") + F.make_interval(hours=F.lit(slot_start_h)))
               & (F.col(TS) < day.cast("timestamp_ntz") + F.make_interval(hours=F.lit(slot_end_h))))
    per_ts = (readings.where(in_slot)
              .groupBy(TS)
              .agg(F.count_if(F.col(Y) == 0).alias("zeros"))
              .select(F.to_date(TS).alias("day"),
                      (F.col("zeros") == F.lit(n_clients)).cast("double").alias("all_zero")))
    per_day = per_ts.groupBy("day").agg(F.count(F.lit(1)).cast("double").alias("rows"),
                                        F.avg("all_zero").alias("rate"))
    return (days.join(per_day, "day", "left")
            .select(date_text("day").alias("date"),
                    F.coalesce("rows", F.lit(0.0)).alias("rows_01_to_02"),
                    F.coalesce("rate", F.lit(0.0)).alias("all_client_zero_row_rate")))
