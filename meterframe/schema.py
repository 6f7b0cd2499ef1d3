"""Canonical column names and schemas of the long panel."""

from pyspark.sql import types as T

CLIENT = "client_id"
TS = "ts"
Y = "y"
YHAT = "yhat"
MODEL = "model"
SPLIT = "split"

# Readings / hourly panel in long layout: one row per (series, time).
READINGS = T.StructType([
    T.StructField(CLIENT, T.StringType(), True),
    T.StructField(TS, T.TimestampNTZType(), True),
    T.StructField(Y, T.FloatType(), True),
])

# Forecasts in long layout; the model name is data, not a column name.
PREDICTIONS = T.StructType([
    T.StructField(MODEL, T.StringType(), False),
    T.StructField(CLIENT, T.StringType(), True),
    T.StructField(TS, T.TimestampNTZType(), True),
    T.StructField(YHAT, T.DoubleType(), True),
])

# Names the reference uses at its edges (forecasting libraries' convention).
EDGE_NAMES = {CLIENT: "unique_id", TS: "ds"}
