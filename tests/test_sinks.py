"""Sources and sinks read back."""

import datetime as dt
import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import readings
from meterframe.operators import reshape
from meterframe.sources import readers, sinks
from meterframe.sources.readers import client_ids, read_long_csv, read_master_wide


def _r(spark):
    return readings(spark, [("MT_2", "2011-01-01 00:00", 1), ("MT_10", "2011-01-01 00:00", 2),
                            ("MT_2", "2011-01-01 01:00", None), ("MT_10", "2011-01-01 01:00", 4)])


def test_wide_roundtrip_is_identity(spark, tmp_path):
    r = _r(spark)
    names = sorted(r.select("client_id").distinct().toPandas()["client_id"])
    sinks.write_master_wide(r, names, str(tmp_path / "m"))
    wide = spark.read.parquet(str(tmp_path / "m"))
    assert wide.columns == ["timestamp", "MT_10", "MT_2"]
    back = read_master_wide(spark, str(tmp_path / "m"), prefix="MT_")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, r.collect()), key=str)
    assert reshape.select_series_columns(wide, prefix="MT_") == ["MT_10", "MT_2"]


def test_long_csv_and_client_list(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("timestamp,client_id,y\n2011-01-01 00:00:00,MT_1,1.5\n2011-01-01 01:00:00,MT_1,\n")
    df = read_long_csv(spark, str(p))
    assert [r["y"] for r in df.orderBy("ts").collect()] == [1.5, None]
    sinks.write_client_list(_r(spark), str(tmp_path / "ids"))
    ids = spark.read.option("header", True).csv(str(tmp_path / "ids"))
    assert sorted(r[0] for r in ids.collect()) == ["MT_10", "MT_2"]
    assert client_ids(df).count() == 1


def test_splits_partitioned_and_pruned(spark, tmp_path):
    r = _r(spark).withColumn("split", F.when(F.hour("ts") == 0, "train").otherwise("test"))
    sinks.write_splits(r, str(tmp_path / "s"))
    test = spark.read.parquet(str(tmp_path / "s")).where(F.col("split") == "test")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert test.count() == 2


def test_model_table_by_phase_and_missing(spark, tmp_path):
    path = str(tmp_path / "models")
    t = spark.createDataFrame([("arima", "A", "ok", 1.0, "test"), ("arima", "A", "ok", 2.0, "validation")],
                              "model string, client_id string, status string, aicc double, phase string")
    sinks.write_model_table(t, path)
    sinks.write_model_table(t.where("phase = 'test'").withColumn("aicc", F.lit(3.0)), path)     # one phase again
    back = sinks.read_model_table(spark, path)
    assert {(r.phase, r.aicc) for r in back.collect()} == {("test", 3.0), ("validation", 2.0)}
    assert sinks.read_model_table(spark, str(tmp_path / "nope")) is None


def test_edge_names_and_single_series(spark):
    r = _r(spark)
    e = reshape.to_edge_names(r)
    assert e.columns == ["unique_id", "ds", "y"]
    assert reshape.from_edge_names(e).columns == ["client_id", "ts", "y"]
    agg = spark.createDataFrame([(dt.datetime(2011, 1, 1), 3.0)], "ts timestamp_ntz, total double")
    s = reshape.as_single_series(agg, "total").first()
    assert s["client_id"] == "aggregate" and s["y"] == 3.0


def test_bucketed_master_avoids_shuffle(spark):
    from meterframe.operators import panel
    spark.sql("DROP TABLE IF EXISTS mf_master_bucketed")
    r = readings(spark, [(f"S{i % 7}", f"2011-01-01 {h:02d}:00", float(i + h)) for i in range(7) for h in range(12)])
    sinks.write_master_bucketed(r, "mf_master_bucketed", 4)
    t = spark.table("mf_master_bucketed")
    lb = panel.lookback(t, 3)
    stats = t.groupBy("client_id").agg(F.max("ts"))
    for df in (lb, stats):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    assert lb.count() == 21
    spark.sql("DROP TABLE IF EXISTS mf_master_bucketed")


def _texts(spark, tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_wide_text_of_50000_series_has_a_small_plan(spark, tmp_path):
    n = 50_000
    lines = [";".join(['""', *(f'"MT_{i:05d}"' for i in range(n))])]
    for h in range(3):
        lines.append(";".join([f'"2011-01-01 {h:02d}:00:00"', *(f"{i % 7},{h}" for i in range(n))]))
    df = readers.read_wide_text(spark, _texts(spark, tmp_path, "wide.txt", "\n".join(lines) + "\n"))
    plan = df._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1 and plan.output().size() == 3
    assert df.count() == 3 * n
    got = df.where("client_id in ('MT_00000', 'MT_00013', 'MT_49999')").collect()
    assert {(r.client_id, r.ts.hour): round(r.y, 1) for r in got} == {
        (c, h): round(v + h / 10, 1) for c, v in (("MT_00000", 0), ("MT_00013", 6), ("MT_49999", 49_999 % 7)) for h in range(3)}


def test_wide_text_lines_of_any_shape(spark, tmp_path):
    text = "when;a;b\r\n2011-01-01 00:00:00;1,5;x\r\n\r\nbad;1;2\r\n2011-01-01 01:00:00;2\r\n2011-01-01 02:00:00;3;4;5\r\n"
    path = _texts(spark, tmp_path, "odd.txt", text)
    got = {(r.client_id, r.ts.hour): r.y for r in readers.read_wide_text(spark, path).collect()}
    assert got == {("a", 0): 1.5, ("b", 0): None, ("a", 1): 2.0, ("b", 1): None, ("a", 2): 3.0, ("b", 2): 4.0}
    assert readers.read_wide_text(spark, path, decimal=".").where("y = 1.5").count() == 0
    assert readers.read_wide_text(spark, _texts(spark, tmp_path, "empty.txt", "")).count() == 0
    assert readers.read_wide_text(spark, _texts(spark, tmp_path, "head.txt", "when;a\n")).count() == 0
    pipes = _texts(spark, tmp_path, "pipes.txt", "when|a\n2011-01-01 00:00:00|7\n")
    assert [r.y for r in readers.read_wide_text(spark, pipes, sep="|").collect()] == [7.0]


def test_blocks_and_wide_table_hold_the_same(spark, tmp_path):
    names = [f"S{i:04d}" for i in range(600)]                       # three blocks of 256
    rows = [(n, f"2011-01-01 {h:02d}:00", float(i + h)) for i, n in enumerate(names) for h in range(3) if (i + h) % 5]
    r = readings(spark, [*rows, ("S0001", "2011-01-01 04:00", None)])
    clients = spark.createDataFrame([(n,) for n in names], "client_id string")
    sinks.write_master_blocks(r, clients, str(tmp_path / "blocks"))
    manifest = spark.read.parquet(str(tmp_path / "blocks" / "manifest")).orderBy("ordinal").collect()
    assert [(m.client_id, m.block, m.place) for m in manifest] == [(n, i // 256, i % 256) for i, n in enumerate(names)]
    back = readers.read_master_blocks(spark, str(tmp_path / "blocks")).where("y is not null")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.where("y is not null").collect()))
    sinks.write_master_wide(r, names[::-1], str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert wide.columns == ["timestamp", *names[::-1]] and wide.count() == 4
    row = wide.where("hour(timestamp) = 2").first()
    assert [row[n] for n in names] == [float(i + 2) if (i + 2) % 5 else None for i in range(600)]
    header = sinks.write_wide_text(r, clients, str(tmp_path / "text"))
    text = readers.read_wide_text(spark, str(tmp_path / "text"), header=header).where("y is not null")
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, r.where("y is not null").collect()))


def test_metadata_is_the_document_dumped_as_a_whole(spark, tmp_path):
    ids = ['b"x', "a", "ü\\", "z"]
    first = {"a": "2011", 'b"x': None, "ü\\": "x", "z": ""}
    doc = {"k": 1, "active": None, "first": None, "none": None, "end": [1]}
    path = str(tmp_path / "new" / "meta.json")
    sinks.write_metadata(spark, doc, path, {
        "active": spark.createDataFrame([(i,) for i in ids], "client_id string"),
        "first": spark.createDataFrame(list(first.items()), "client_id string, f string"),
        "none": spark.createDataFrame([], "client_id string")})
    want = doc | {"active": sorted(ids), "first": dict(sorted(first.items())), "none": []}
    assert sinks.read_text_file(spark, path) == json.dumps(want, ensure_ascii=False, indent=2)


def test_wide_table_in_files_of_a_week_without_dictionaries(spark, tmp_path):
    """A task of the writer holds little for a column: no dictionary, no generated code, and one writer a week."""
    names = ["a", "b.c", "d`e", "{f}", "${g}"]
    start = dt.datetime(2011, 1, 1)
    rows = [(n, str(start + dt.timedelta(hours=h)), float(h % 5 + i)) for h in range(400) for i, n in enumerate(names) if (h + i) % 3]
    key = "spark.sql.codegen.factoryMode"
    before = spark.conf.get(key, None)
    sinks.write_master_wide(readings(spark, rows), names, str(tmp_path / "w"))
    assert spark.conf.get(key, None) == before
    files = [pq.ParquetFile(f) for f in (tmp_path / "w").glob("*.parquet")]
    assert len(files) == 3
    assert not any(f.metadata.row_group(0).column(i).has_dictionary_page for f in files for i in range(1, 6))
    spans = sorted((min(t), max(t)) for t in (f.read(["timestamp"])["timestamp"].to_pylist() for f in files))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    cells = readers.read_wide_cells(spark, str(tmp_path / "w")).collect()
    assert len(cells) == 400 * 5 and {(r.ordinal, r.client_id) for r in cells} == set(enumerate(names, 1))
    assert sorted((r.client_id, str(r.ts), r.y) for r in cells if r.y is not None) == sorted(rows)


def test_wide_table_is_read_in_groups_of_columns(spark, tmp_path, monkeypatch):
    """No scan of the read-back has buffers for more columns than a group has."""
    names = [f"S{i:03d}" for i in range(100)]
    rows = [(n, f"2011-01-01 {h:02d}:00:00", float(i + h)) for i, n in enumerate(names) for h in range(3) if (i + h) % 5]
    sinks.write_master_wide(readings(spark, rows), names, str(tmp_path / "w"))
    monkeypatch.setattr(readers, "WIDE_GROUP", 30, raising=False)
    back = read_master_wide(spark, str(tmp_path / "w"))
    scans = [leaf.output().size() for leaf in _leaves(back)]
    assert len(scans) == 4 and max(scans) <= 31
    assert back.count() == 300
    assert sorted((r.client_id, str(r.ts), r.y) for r in back.where("y is not null").collect()) == sorted(rows)
    cells = readers.read_wide_cells(spark, str(tmp_path / "w")).where("hour(ts) = 1").orderBy("ordinal").collect()
    assert [(r.ordinal, r.client_id) for r in cells] == list(enumerate(names, 1))


def _leaves(df):
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_wide_table_without_series(spark, tmp_path):
    sinks.write_master_wide(_r(spark).limit(0), [], str(tmp_path / "w"))
    back = readers.read_wide_cells(spark, str(tmp_path / "w"))
    assert back.dtypes == [("ts", "timestamp_ntz"), ("ordinal", "int"), ("client_id", "string"), ("y", "double")]
    assert back.count() == 0
