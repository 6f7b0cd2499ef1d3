"""Total load across series per hour (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLIENT, TS, Y

AGG_COL = "aggregate_hourly_kW"


def aggregate_load(hourly: DataFrame, spine: DataFrame, keep: DataFrame | None = None,
                   out: str = AGG_COL) -> DataFrame:
    """Sum of the kept series per spine hour; missing values are skipped and
    an hour without any value gives 0.0.

    ``keep`` (``client_id``) restricts the series with a semi join.  The sum is
    partial per map task, so an hour shared by millions of series never
    concentrates raw rows in one reducer.
    """
    panel = hourly if keep is None else hourly.join(keep.select(CLIENT), CLIENT, "left_semi")
    sums = panel.groupBy(TS).agg(F.sum(F.col(Y).cast("double")).alias("_s"))
    return (spine.select(TS).join(sums, TS, "left")
            .select(TS, F.coalesce("_s", F.lit(0.0)).alias(out)))
