"""Time scalar functions (X1, X4-X6, X9) on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_TEXT = "yyyy-MM-dd HH:mm:ss"
DATE_TEXT = "yyyy-MM-dd"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def floor_hour(col) -> Column:
    """Start of the hour, staying TIMESTAMP_NTZ and independent of the
    session time zone (``date_trunc`` would return TIMESTAMP)."""
    return F.window(_c(col), "1 hour").start


def weekday0(col) -> Column:
    """Day of week with Monday = 0 .. Sunday = 6 (the pandas convention)."""
    return F.weekday(_c(col))


def ts_text(col) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` as pandas prints a timestamp."""
    return F.date_format(_c(col), TS_TEXT)


def date_text(col) -> Column:
    return F.date_format(_c(col), DATE_TEXT)


def utc_offset_seconds(local_ts, tz: str) -> Column:
    """UTC offset in seconds of a naive local time in zone ``tz``."""
    ts = _c(local_ts)
    return F.timestamp_diff("SECOND", F.to_utc_timestamp(ts, tz), ts)


def day_end(day_col) -> Column:
    """Last second of a day: ``day + 1 day - 1 s`` (window upper bound, P1)."""
    return (F.to_date(_c(day_col)).cast("timestamp_ntz")
            + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND"))


def hour_sequence(lo, hi) -> Column:
    """Every hour from ``lo`` to ``hi`` inclusive (A3 spine generator)."""
    return F.sequence(_c(lo), _c(hi), F.expr("INTERVAL 1 HOUR"))


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a Python datetime / date / string.

    Goes through the ISO text, so no time zone is involved: a naive datetime
    handed to ``F.lit`` becomes a TIMESTAMP in the Python process's local zone
    and would shift when cast with a different session zone."""
    if hasattr(value, "isoformat"):
        value = value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")
