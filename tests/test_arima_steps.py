"""Steps of the ARIMA fit against plain NumPy."""
import numpy as np
from meterframe.forecast import arima
from meterframe.forecast.arrays import autoregression, products, remainder
from pyspark.sql import functions as F


def test_recursion_solves_the_system_of_the_autocovariances(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=300).cumsum()
    z -= z.mean()
    cov = [float(z[j:] @ z[:300 - j] / 300) for j in range(29)]
    wave = [float(np.cos(j * np.pi / 3)) for j in range(29)]              # two lags say all
    rows = spark.createDataFrame([("z", cov), ("wave", wave), ("zero", [0.0] * 29)], "k string, cov array<double>")
    got = {r.k: np.array(r.a) for r in rows.select("k", autoregression(F.col("cov"), 28).alias("a")).collect()}
    want = np.linalg.solve([[cov[abs(i - j)] for j in range(28)] for i in range(28)], cov[1:])
    assert np.allclose(got["z"], want, atol=1e-9)
    assert np.allclose(got["wave"][:2], [1.0, -1.0]) and not got["wave"][2:].any()
    assert len(got["zero"]) == 28 and not got["zero"].any()


def test_candidates_share_eliminations(spark):
    """What each of the 48 candidates leaves, with and without a constant."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(80, 9)) @ rng.normal(size=(9, 9))
    v[:, 7] = 1.0
    m = (v.T @ v).tolist()
    rows = spark.createDataFrame([(m, True), (m, False)], "m array<array<double>>, const boolean")
    got = {r.const: r.left for r in rows.select("const", arima._sums_left(F.col("m"), F.col("const")).alias("left")).collect()}
    for const in (True, False):
        want = []
        for order in arima.orders(arima.Settings()):
            pick = arima.columns_of(order) + ([7] if const else [])
            w = np.linalg.lstsq(v[:, pick], v[:, 8], rcond=None)[0] if pick else np.zeros(0)
            want.append(((v[:, 8] - v[:, pick] @ w) ** 2).sum())
        assert np.allclose(got[const], want, rtol=1e-6)


def test_products_and_remainder(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]],)], "v array<array<double>>")
    got = rows.select(products(F.col("v")).alias("m"), remainder(F.col("v")[0], F.array(
        F.struct(F.lit(2.0).alias("w"), F.col("v")[1].alias("x")), F.struct(F.lit(-1.0).alias("w"), F.col("v")[2].alias("x")))).alias("r")).first()
    v = np.array([[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]])
    assert np.allclose(got.m, v @ v.T) and np.allclose(got.r, v[0] - 2 * v[1] + v[2])
