"""Two closed-form forecasters expressible in SQL, used as stand-ins when the
scoring operators are checked against DuckDB: the series' train mean by hour
of day (falling back to its train mean) and its last train value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLIENT, TS, Y, YHAT


def hour_of_day_mean(train: DataFrame, axis: DataFrame) -> DataFrame:
    """``client_id, ts, yhat`` for every row of ``axis``."""
    hod = train.groupBy(CLIENT, F.hour(TS).alias("_hr")).agg(F.avg(Y).alias("_m"))
    overall = train.groupBy(CLIENT).agg(F.avg(Y).alias("_all"))
    return (axis.select(CLIENT, TS).withColumn("_hr", F.hour(TS))
            .join(hod, [CLIENT, "_hr"], "left")
            .join(overall, CLIENT, "left")
            .select(CLIENT, TS, F.coalesce("_m", "_all").cast("double").alias(YHAT)))


def last_value(train: DataFrame, axis: DataFrame) -> DataFrame:
    """Naive forecast: the last train value of the series."""
    last = train.groupBy(CLIENT).agg(F.max_by(Y, TS).cast("double").alias(YHAT))
    return axis.select(CLIENT, TS).join(last, CLIENT, "left")
