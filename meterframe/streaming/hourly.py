"""Hourly downsampling of a stream of readings (A1 + A2 under Structured
Streaming).

The batch operator averages duplicate readings of a timestamp first and then
the distinct timestamps of the hour (mean of means, trap T1).  The stream
keeps that order with two chained stateful aggregations in append mode: the
watermark on ``ts`` closes a (series, timestamp) group and then the hour that
contains it; late readings beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLIENT, READINGS, TS, Y


def read_readings_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                         max_files: int | None = None) -> DataFrame:
    """File source of readings with the canonical schema."""
    r = spark.readStream.format(fmt).schema(READINGS)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def hourly_mean_stream(readings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Streaming A1 + A2.  Output ``client_id, ts (hour), y`` in append mode:
    an hour is emitted once the watermark has passed its end."""
    # watermarks need TIMESTAMP; with the session in UTC the cast keeps the
    # wall-clock value, and the hour start is cast back to TIMESTAMP_NTZ
    et = readings.withColumn("_et", F.col(TS).cast("timestamp")).withWatermark("_et", delay)
    per_ts = et.groupBy(CLIENT, "_et").agg(F.avg(Y).alias("_m"))
    per_hour = (per_ts.groupBy(F.col(CLIENT), F.window("_et", "1 hour").alias("_h"))
                .agg(F.avg("_m").cast("float").alias(Y)))
    return per_hour.select(CLIENT, F.col("_h.start").cast("timestamp_ntz").alias(TS), Y)
