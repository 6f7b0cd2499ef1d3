"""Steps of the fits that were the larger part of their time."""
import datetime as dt

import numpy as np
import pytest
from meterframe.forecast import arima, arrays, smoothing
from pyspark.sql import functions as F
from test_forecast import noisy, smooth


@pytest.mark.parametrize("n", [50, 61, 96])
def test_sums_of_the_coarse_grid_equal_the_plain_recursion(spark, n):
    """Season by hour and numbers in the steps, also with an incomplete last period."""
    df, values = noisy(spark, n=n, n_series=2)
    s = smoothing.Settings()
    rows = arrays.series(df).withColumn("first_mean", arrays.mean(F.slice("y", 1, 24))) \
        .withColumn("step_of_means", (arrays.mean(F.slice("y", 25, 24)) - F.col("first_mean")) / 24)
    plain, seasonal = ([r for r in smoothing.grid(s) if r["seasonal"] == x] for x in (0, 1))
    got = rows.select("client_id", F.concat(smoothing._coarse_plain(plain), smoothing._coarse_seasonal(seasonal, s)).alias("sse")).collect()
    for r in got:
        y = values[r.client_id]
        assert np.allclose(r.sse, [((y - smooth(y, q)[0]) ** 2).sum() for q in plain + seasonal])


def test_series_needs_no_window(spark):
    """Missing values are filled on the array: the rows are not sorted once forth and once back."""
    rows = [("a", dt.datetime(2014, 1, 6) + dt.timedelta(hours=i), v) for i, v in enumerate([None, 3.0, None, None, 9.0, 1.0, None])]
    got = arrays.series(spark.createDataFrame(rows, "client_id string, ts timestamp_ntz, y double"))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first().y == [3.0, 3.0, 5.0, 7.0, 9.0, 1.0, 1.0]


def test_a_step_of_the_arima_path_is_evaluated_once(spark):
    """The path holds its forecast once, not once for each difference that is undone."""
    columns = "weight array<double>, x_tail array<double>, e_tail array<double>, r_tail array<double>, u_tail array<double>, d int, seasonal_d int"
    zeros = [0.0] * 27
    df = spark.createDataFrame([([0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], [*zeros[1:], 2.0], zeros, [*zeros[1:], 7.0], [*zeros[1:], 7.0], 1, 0)], columns)
    got = df.select(arima.path(F.lit(3)).alias("r"))
    assert got.first().r == [9.0, 11.0, 13.0]
    expression = next(line for line in got._jdf.queryExecution().analyzed().toString().splitlines() if "Project" in line)
    assert expression.count("weight#") == 8
