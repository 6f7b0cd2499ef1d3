"""Scoring tests (FIXTURES B6, B7, B15, B19)."""

import datetime as dt

from meterframe.functions.numeric import round_half_up
from meterframe.operators import evaluate


def _pairs(spark, rows):
    return spark.createDataFrame(
        [(c, dt.datetime(2014, 1, 1) + dt.timedelta(hours=i), y, p) for i, (c, y, p) in enumerate(rows)],
        "client_id string, ts timestamp_ntz, y double, yhat double")


def _by_client(df):
    return {r["client_id"]: (r["MSE"], r["MAE"], r["WAPE"]) for r in df.collect()}


def test_b6_zero_denominator(spark):
    m = _by_client(evaluate.metrics_table(_pairs(spark, [("A", 0.0, 1.0), ("A", 0.0, 1.0)])))
    assert m["A"] == (1.0, 1.0, None)


def test_b7_missing_pairs(spark):
    m = _by_client(evaluate.metrics_table(_pairs(spark, [("A", 2.0, 1.0), ("A", None, 5.0),
                                                         ("A", 4.0, None), ("B", None, 1.0)])))
    assert m["A"] == (1.0, 1.0, 0.5)
    assert m["B"] == (None, None, None)
    # notebook rules: a missing value makes the group's metrics missing
    nb = _by_client(evaluate.metrics_table(_pairs(spark, [("A", 2.0, 1.0), ("A", None, 5.0)]),
                                           null_safe=False, digits=4))
    assert nb["A"] == (None, None, None)


def test_b15_pooled_overall(spark):
    rows = [("A", 1.0, 2.0)] + [("B", 10.0, 10.0)] * 3
    m = _by_client(evaluate.metrics_table(_pairs(spark, rows), digits=4))
    assert m["OVERALL"] == (0.25, 0.25, 0.0323)


def test_b19_skipped_series(spark):
    panel = spark.createDataFrame([("A",), ("B",)], "client_id string")
    models = spark.createDataFrame([("A", "x")], "client_id string, model string")
    assert [r[0] for r in evaluate.skipped_series(panel, models).collect()] == ["B"]


def test_leaderboard_and_wide(spark):
    act = spark.createDataFrame([("A", dt.datetime(2014, 1, 1), 1.0)], "client_id string, ts timestamp_ntz, y double")
    preds = spark.createDataFrame([("m1", "A", dt.datetime(2014, 1, 1), 2.0),
                                   ("m2", "A", dt.datetime(2014, 1, 1), 1.5)],
                                  "model string, client_id string, ts timestamp_ntz, yhat double")
    lb = {r["model"]: r["rank"] for r in evaluate.leaderboard(evaluate.metrics_by_model(act, preds)).collect()}
    assert lb == {"m2": 1, "m1": 2}
    w = evaluate.wide_by_model(act, preds, ["m1", "m2"]).first()
    assert (w["m1"], w["m2"]) == (2.0, 1.5)


def test_nan_is_missing_and_never_scores(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("good", "A", 2.0, 2.5), ("good", "A", 4.0, 4.0), ("nan", "A", 2.0, nan), ("nan", "A", 4.0, 9.0),
            ("all", "A", 2.0, nan), ("all", "A", nan, 1.0)]
    pairs = spark.createDataFrame(rows, "model string, client_id string, y double, yhat double")
    got = {(r.model, r.client_id): r for r in evaluate.metrics_table(pairs, digits=4, by_model=True).collect()}
    assert got["nan", "A"].MAE == 5.0 and got["nan", "OVERALL"].MSE == 25.0
    assert got["all", "A"].MSE is None and got["all", "OVERALL"].WAPE is None
    board = evaluate.leaderboard(evaluate.metrics_table(pairs, digits=4, by_model=True)).orderBy("rank").collect()
    assert [r.model for r in board] == ["good", "nan", "all"]
    x = spark.createDataFrame([(nan,), (inf,), (-inf,), (1.5e300,), (9.3e14,), (0.00005,), (None,)], "x double")
    assert [r[0] for r in x.select(round_half_up("x", 4)).collect()] == [
        None, inf, -inf, 1.5e300, 9.3e14, 0.0001, None]
