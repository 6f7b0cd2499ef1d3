"""Running forecast errors over a stream of scored pairs (A12 under
Structured Streaming).

State is one row of partial sums per (model, series): bounded by the number
of series and models, not by the stream length, so no watermark is needed.
Update mode emits the changed series each trigger; the figures equal the
batch ``evaluate.metrics_table`` over everything seen so far (dashboard
rules: pairs with a missing side, NULL or NaN, are ignored)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..schema import CLIENT, MODEL, Y, YHAT


def running_metrics(pairs: DataFrame) -> DataFrame:
    """``pairs``: stream of ``model, client_id, ts, y, yhat``.  Output
    ``model, client_id, n, MSE, MAE, WAPE`` in update mode."""
    y, p = nan_to_null(F.col(Y).cast("double")), nan_to_null(F.col(YHAT).cast("double"))
    e = F.when(y.isNotNull() & p.isNotNull(), y - p)
    sums = pairs.groupBy(MODEL, CLIENT).agg(
        F.count(e).alias("n"), F.sum(e * e).alias("_sq"), F.sum(F.abs(e)).alias("_ab"),
        F.sum(F.when(e.isNotNull(), F.abs(y))).alias("_den"))
    n = F.col("n").cast("double")
    return sums.select(MODEL, CLIENT, "n",
                       F.try_divide(F.col("_sq"), F.nullif(n, F.lit(0.0))).alias("MSE"),
                       F.try_divide(F.col("_ab"), F.nullif(n, F.lit(0.0))).alias("MAE"),
                       F.try_divide(F.col("_ab"), F.nullif(F.col("_den"), F.lit(0.0))).alias("WAPE"))
