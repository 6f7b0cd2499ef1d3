"""De-duplication, hourly downsampling and the hour spine (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefns import floor_hour, hour_sequence, ntz_lit
from ..schema import CLIENT, TS, Y
from .partitioning import spread


def dedupe_mean(readings: DataFrame) -> DataFrame:
    """A1: duplicate (series, timestamp) readings -> their mean, FLOAT.

    ``avg`` has a partial (sum, count) form, so a hot key is reduced map-side
    before the shuffle."""
    return (readings.groupBy(CLIENT, TS)
            .agg(F.avg(Y).cast("float").alias(Y)))


def hourly_mean(readings: DataFrame, dedupe: bool = True) -> DataFrame:
    """A1 + A2: hourly mean of the readings present in ``[h, h+1)``.

    Duplicates are averaged first, then the distinct timestamps of the hour
    (mean of means, trap T1).  An hour whose readings are all missing has a
    NULL value; an hour without any row has no row (see :func:`densify`).
    """
    base = dedupe_mean(readings) if dedupe else readings
    return (base.groupBy(CLIENT, floor_hour(TS).alias(TS))
            .agg(F.avg(Y).cast("float").alias(Y)))


def time_bounds(df: DataFrame, ts: str = TS, hourly: bool = False) -> tuple:
    """(min, max) of a timestamp column: one small driver action.

    ``hourly=True`` returns the first and last *hour*, i.e. the bounds of
    the hourly panel of ``df``, without computing that panel."""
    c = floor_hour(ts) if hourly else F.col(ts)
    row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    if row is None or row["lo"] is None:
        raise ValueError("empty input: no timestamps")
    return row["lo"], row["hi"]


def hour_spine(hourly: DataFrame, lo=None, hi=None) -> DataFrame:
    """A3: every hour between the first and last hour of the panel, as in a
    pandas resample of the shared wide index.  One row per hour of the time
    range; its size does not grow with the number of series."""
    if lo is None or hi is None:
        lo, hi = time_bounds(hourly)
    spark = hourly.sparkSession
    return spark.range(1).select(
        F.explode(hour_sequence(ntz_lit(lo),
                                ntz_lit(hi))).alias(TS))


def series_axis(clients: DataFrame, spine: DataFrame, lo, hi) -> DataFrame:
    """Every (series, spine hour).  Each series generates its own hour axis
    with ``sequence`` (a generator, not a cross join); hours missing from the
    spine (removed days) are removed with a semi join on the spine, whose size
    is the number of hours in the range."""
    ids = spread(clients.select(CLIENT).distinct(), (hi - lo).total_seconds() // 3600 + 1)
    axis = ids.select(CLIENT, F.explode(hour_sequence(
        ntz_lit(lo), ntz_lit(hi))).alias(TS))
    return axis.join(spine.select(TS), TS, "left_semi")


def densify(hourly: DataFrame, spine: DataFrame, clients: DataFrame | None = None,
            lo=None, hi=None) -> DataFrame:
    """A3 dense panel: every (series, spine hour), missing hours as NULL."""
    if lo is None or hi is None:
        lo, hi = time_bounds(spine)
    axis = series_axis(clients if clients is not None else hourly, spine, lo, hi)
    return axis.join(hourly.select(CLIENT, TS, Y), [CLIENT, TS], "left")
