"""Streaming hourly means equal the batch operator on the same readings."""

import datetime as dt

from conftest import readings
from meterframe.operators import resample
from meterframe.streaming.hourly import hourly_mean_stream, read_readings_stream


def test_stream_matches_batch(spark, tmp_path):
    base = dt.datetime(2011, 1, 1)
    rows = []
    for h in range(6):
        for q in range(4):
            t = (base + dt.timedelta(hours=h, minutes=15 * q)).isoformat(sep=" ")
            rows.append(("A", t, h + q))
            rows.append(("B", t, 2 * h))
    rows.append(("A", "2011-01-01 00:00", 10))           # duplicate timestamp
    df = readings(spark, rows)
    src = tmp_path / "in"
    df.repartition(3).write.parquet(str(src))
    stream = hourly_mean_stream(read_readings_stream(spark, str(src)), delay="1 hour")
    q = (stream.writeStream.outputMode("append").format("memory").queryName("hourly_t")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r["client_id"], r["ts"]): r["y"] for r in spark.sql("select * from hourly_t").collect()}
    want = {(r["client_id"], r["ts"]): r["y"] for r in resample.hourly_mean(df).collect()}
    # hours still inside the watermark delay are not emitted yet
    assert got and set(got) <= set(want)
    for k, v in got.items():
        assert abs(v - want[k]) < 1e-6, k
    assert got[("A", base)] == want[("A", base)]


def test_running_metrics_equal_batch(spark, tmp_path):
    from meterframe.operators import evaluate
    from meterframe.streaming.metrics import running_metrics
    rows = [("m", "A", dt.datetime(2014, 1, 1, h), float(h), float(h) + (1 if h % 2 else -2)) for h in range(12)]
    rows += [("m", "B", dt.datetime(2014, 1, 1, h), 0.0, 1.0) for h in range(3)]
    schema = "model string, client_id string, ts timestamp_ntz, y double, yhat double"
    df = spark.createDataFrame(rows, schema)
    src = tmp_path / "pairs"
    df.repartition(4).write.parquet(str(src))
    stream = running_metrics(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = (stream.writeStream.outputMode("update").format("memory").queryName("run_metrics")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("select * from run_metrics").collect():
        if r["n"] >= last.get(r["client_id"], {"n": -1})["n"]:
            last[r["client_id"]] = r.asDict()
    batch = {r["client_id"]: r for r in evaluate.metrics_by_model(df.select("client_id", "ts", "y"),
                                                                  df.select("model", "client_id", "ts", "yhat")).collect()}
    for c in ("A", "B"):
        assert abs(last[c]["MSE"] - batch[c]["MSE"]) < 1e-12
        assert abs(last[c]["MAE"] - batch[c]["MAE"]) < 1e-12
    assert last["B"]["WAPE"] is None and batch["B"]["WAPE"] is None
