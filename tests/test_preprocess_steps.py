"""Operator tests on the small inputs of FIXTURES.md (parts A and B)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T, readings
from meterframe.operators import activity, aggregate, dst, integrity, panel, resample
from meterframe.sources.readers import read_wide_text


def _sorted(df, *cols):
    return [tuple(r) for r in df.orderBy(*cols).collect()]


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


# A1: load and window -------------------------------------------------------

def test_load_window_and_integrity(spark, tmp_path):
    """A duplicate, a missing quarter of an hour, and a row outside the window."""
    path = _write(tmp_path, "mills.txt", "at;mill;kiln\n"
                  "2012-05-06 10:00:00;7,5;\n2012-05-06 10:15:00;8;2\n2012-05-06 10:15:00;10;2\n"
                  "2012-05-06 10:45:00;9;4\n2012-05-07 00:00:00;1;1\n")
    raw = panel.analysis_window(read_wide_text(spark, path), "2012-05-05", "2012-05-06")
    readings_ = resample.dedupe_mean(raw)
    rep = integrity.integrity_report(readings_, 900, raw=raw).first()
    assert (rep["rows"], rep["clients"], rep["non_15m_intervals"]) == (3, 2, 1)
    assert (rep["start"], rep["end"]) == ("2012-05-06 10:00:00", "2012-05-06 10:45:00")
    mill = _sorted(readings_.where("client_id = 'mill'"), "ts")
    assert [r[2] for r in mill] == [7.5, 9.0, 9.0]


def test_b5_lenient_parse(spark, tmp_path):
    path = _write(tmp_path, "b5.txt", "Date;MT_1\n2011-01-01 00:00:00;1,5\n2011-01-01 00:15:00;1.5\n"
                  "2011-01-01 00:30:00;abc\n2011-01-01 00:45:00;\nbad;7\n")
    got = _sorted(read_wide_text(spark, path), "ts")
    assert [r[2] for r in got] == [1.5, 1.5, None, None]
    assert all(r[0] == "MT_1" for r in got)


def test_b13_window_end(spark):
    df = readings(spark, [("A", "2011-01-01 23:59:59", 1), ("A", "2011-01-02 00:00:00", 2)])
    got = panel.analysis_window(df, "2011-01-01", "2011-01-01").collect()
    assert [r["y"] for r in got] == [1.0]


# A2: downsample and inactive ------------------------------------------------

def _three(spark):
    """Three hours of three series: steady, idle after the first hour, never on."""
    rows = []
    for step in range(12):
        t = (dt.datetime(2012, 2, 3, 8) + dt.timedelta(minutes=15 * step)).isoformat(sep=" ")
        rows += [("steady", t, 4 + step % 4), ("idle", t, 6 if step < 4 else 0), ("off", t, 0)]
    return readings(spark, rows)


def _stats(hourly, clients, rate_min, run_max, tz="Europe/Lisbon"):
    lo, hi = resample.time_bounds(hourly)
    dates = dst.transition_dates_for(hourly, tz)
    kept = dst.drop_days(hourly, dates)
    return activity.activity_stats(kept, clients, lo, hi, dates, rate_min, run_max), dates


def test_downsample_and_inactive(spark):
    r = _three(spark)
    hourly = resample.hourly_mean(r)
    at = [T(f"2012-02-03 {h:02d}:00") for h in (8, 9, 10)]
    assert _sorted(hourly, "client_id", "ts") == [
        *[("idle", t, y) for t, y in zip(at, (6.0, 0.0, 0.0), strict=True)],
        *[("off", t, 0.0) for t in at], *[("steady", t, 5.5) for t in at]]
    stats, dates = _stats(hourly, r.select("client_id"), 0.3, 2)
    assert dates == []
    got = {x["client_id"]: x for x in stats.collect()}
    assert {k for k, x in got.items() if x["active"]} == {"steady", "idle"}
    assert [got[k]["max_zero_run"] for k in ("steady", "idle", "off")] == [0, 2, 3]
    assert abs(got["idle"]["nonzero_rate"] - 1 / 3) < 1e-9
    assert got["steady"]["first_nonzero_ts"] == at[0] and got["off"]["first_nonzero_ts"] is None


def test_b1_gap(spark):
    r = readings(spark, [("A", "2011-01-01 00:15", 4), ("A", "2011-01-01 03:15", 8)])
    hourly = resample.hourly_mean(r)
    spine = resample.hour_spine(hourly)
    dense = resample.densify(hourly, spine)
    assert [x[2] for x in _sorted(dense, "ts")] == [4.0, None, None, 8.0]
    stats, _ = _stats(hourly, r.select("client_id"), 0.5, 2)
    s = stats.first()
    assert s["nonzero_rate"] == 0.5 and s["max_zero_run"] == 2 and s["active"]
    agg = aggregate.aggregate_load(hourly, spine)
    assert [x[1] for x in _sorted(agg, "ts")] == [4.0, 0.0, 0.0, 8.0]
    assert integrity.irregular_steps(r, 900).count() == 1
    assert activity.incomplete_days(spine).first()["hours"] == 4


def test_b2_duplicates_mean_of_means(spark):
    r = readings(spark, [("A", "2011-01-01 00:00", 2), ("A", "2011-01-01 00:00", 4),
                         ("A", "2011-01-01 00:15", 9)])
    assert [x[2] for x in _sorted(resample.dedupe_mean(r), "ts")] == [3.0, 9.0]
    assert resample.hourly_mean(r).first()["y"] == 6.0
    rep = integrity.integrity_report(resample.dedupe_mean(r), 900, raw=r).first()
    assert rep["duplicate_timestamps"] == 0 and rep["raw_duplicate_readings"] == 1


def test_b3_run_across_removed_day(spark):
    rows = []
    t = dt.datetime(2014, 3, 29)
    zeros = {dt.datetime(2014, 3, 29, 22), dt.datetime(2014, 3, 29, 23),
             dt.datetime(2014, 3, 31, 0), dt.datetime(2014, 3, 31, 1)}
    while t <= dt.datetime(2014, 3, 31, 23):
        rows.append(("A", t.isoformat(sep=" "), 0 if t in zeros else 1))
        t += dt.timedelta(hours=1)
    hourly = resample.hourly_mean(readings(spark, rows))
    stats, dates = _stats(hourly, hourly.select("client_id"), 0.5, 10)
    assert dates == [dt.date(2014, 3, 30)]
    s = stats.first()
    assert s["max_zero_run"] == 4 and s["nonzero_rate"] == 44 / 48


def test_b4_strict_thresholds_b9_negative(spark):
    r = readings(spark, [("A", "2011-01-01 00:00", -1), ("A", "2011-01-01 01:00", 0),
                         ("A", "2011-01-01 02:00", 0), ("A", "2011-01-01 03:00", 5)])
    hourly = resample.hourly_mean(r)
    stats, _ = _stats(hourly, r.select("client_id"), 0.5, 2)
    s = stats.first()
    assert s["nonzero_hours"] == 2 and s["nonzero_rate"] == 0.5 and s["max_zero_run"] == 2
    assert s["active"]


def test_b14_nan_source_is_missing(spark):
    from meterframe.sources.readers import readings_from_table
    df = spark.createDataFrame([("A", T("2011-01-01 00:00"), float("nan")),
                                ("A", T("2011-01-01 00:15"), 1.0)], "c string, t timestamp_ntz, v double")
    r = readings_from_table(df, "c", "t", "v")
    assert resample.hourly_mean(r).first()["y"] == 1.0


# DST ---------------------------------------------------------------------

def test_published_lisbon_transitions(spark):
    days = dst.transition_dates(spark, dt.date(2011, 1, 1), dt.date(2014, 12, 31), "Europe/Lisbon")
    got = sorted(r["day"].isoformat() for r in days.collect())
    assert got == ["2011-03-27", "2011-10-30", "2012-03-25", "2012-10-28",
                   "2013-03-31", "2013-10-27", "2014-03-30", "2014-10-26"]


def test_b12_first_day_never_flagged(spark):
    days = dst.transition_dates(spark, dt.date(2014, 3, 30), dt.date(2014, 4, 2), "Europe/Lisbon")
    assert days.count() == 0


def test_b10_b11_snapshot(spark):
    r = readings(spark, [("A", "2014-03-30 01:00", 0), ("B", "2014-03-30 01:00", None),
                         ("A", "2014-03-30 01:15", 0), ("B", "2014-03-30 01:15", 0)])
    snap = dst.artefact_snapshot(r, [dt.date(2014, 3, 30), dt.date(2014, 10, 26)], 2).collect()
    got = {s["date"]: (s["rows_01_to_02"], s["all_client_zero_row_rate"]) for s in snap}
    assert got == {"2014-03-30": (2.0, 0.5), "2014-10-26": (0.0, 0.0)}


def test_b18_lexicographic_names(spark):
    r = readings(spark, [("MT_2", "2011-01-01 00:00", 1), ("MT_10", "2011-01-01 00:00", 1)])
    assert [x[0] for x in panel.client_list(r).collect()] == ["MT_10", "MT_2"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocked_lag_matches_plain_lag(spark, block):
    from meterframe.operators.ordered import previous_in_order
    rows = [("A", p) for p in (0, 1, 5, 6, 7, 20, 21)] + [("B", p) for p in (3, 9)]
    df = spark.createDataFrame(rows, "client_id string, pos long")
    got = _sorted(previous_in_order(df, ["client_id"], "pos", block, out="prev")
                  .select("client_id", "pos", "prev"), "client_id", "pos")
    want = [("A", 0, None), ("A", 1, 0), ("A", 5, 1), ("A", 6, 5), ("A", 7, 6), ("A", 20, 7),
            ("A", 21, 20), ("B", 3, None), ("B", 9, 3)]
    assert got == want


def test_hot_series_zero_run_dense_oracle(spark):
    """One series holding most rows: blocked run equals a brute-force run."""
    import random
    rnd = random.Random(7)
    base = dt.datetime(2012, 1, 1)
    rows = []
    for h in range(24 * 120):
        if rnd.random() < 0.3:
            rows.append(("hot", (base + dt.timedelta(hours=h)).isoformat(sep=" "), rnd.choice([0, 1, 2])))
    rows.append(("cold", base.isoformat(sep=" "), 1))
    rows.append(("cold", (base + dt.timedelta(hours=24 * 120 - 1)).isoformat(sep=" "), 0))
    r = readings(spark, rows)
    hourly = resample.hourly_mean(r)
    stats, _ = _stats(hourly, r.select("client_id"), 0.0, 10**9, tz="UTC")
    got = {s["client_id"]: s["max_zero_run"] for s in stats.collect()}
    vals = {}
    for c, t, y in rows:
        vals.setdefault(c, {})[t] = y
    for c, m in vals.items():
        best = cur = 0
        for h in range(24 * 120):
            t = (base + dt.timedelta(hours=h)).isoformat(sep=" ")
            if m.get(t, 0) == 0:
                cur += 1
                best = max(best, cur)
            else:
                cur = 0
        assert got[c] == best, c


def test_window_filter_pushed_to_parquet(spark, tmp_path):
    r = readings(spark, [("A", "2011-01-01 00:00", 1), ("A", "2011-02-01 00:00", 2)])
    r.write.parquet(str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    plan = panel.analysis_window(back, "2011-01-01", "2011-01-10").select("y")._jdf \
        .queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,y:float>" in plan


def test_lookback_uses_window_group_limit(spark):
    r = readings(spark, [("A", f"2011-01-01 0{h}:00", h) for h in range(6)])
    lb = panel.lookback(r, 3)
    assert sorted(x["y"] for x in lb.collect()) == [3.0, 4.0, 5.0]
    assert "WindowGroupLimit" in lb._jdf.queryExecution().executedPlan().toString()
    # Shorter series are kept whole
    assert panel.lookback(r, 50).count() == 6


def test_splits_disjoint(spark):
    r = readings(spark, [("A", "2014-01-01 00:00", 1), ("A", "2013-12-31 23:00", 1),
                         ("A", "2014-04-30 23:00", 1), ("A", "2014-05-01 00:00", 1)])
    b = panel.SplitBounds("2013-12-31 23:00:00", "2014-01-01 00:00:00", "2014-04-30 23:00:00",
                          "2014-05-01 00:00:00", train_start="2012-01-01 00:00:00")
    s = panel.assign_splits(r, b)
    assert _sorted(s.select("ts", "split"), "ts") == [
        (T("2013-12-31 23:00"), "train"), (T("2014-01-01 00:00"), "validation"),
        (T("2014-04-30 23:00"), "validation"), (T("2014-05-01 00:00"), "test")]
    assert panel.split_overlap(s).count() == 0


def test_b16_horizon_and_chunks(spark):
    rows, t = [], dt.datetime(2014, 1, 1)
    while t < dt.datetime(2014, 5, 1):
        if t.date() != dt.date(2014, 3, 30):
            rows.append(("A", t.isoformat(sep=" "), 1))
        t += dt.timedelta(hours=1)
    r = readings(spark, rows)
    assert panel.horizon(r) == 2856
    ch = panel.chunk_index(r, 720)
    assert ch.agg(F.max("chunk")).first()[0] == 3
    assert ch.agg(F.max("pos")).first()[0] == 2855


def test_t12_empty_input_is_an_error(spark):
    empty = readings(spark, [("A", "2011-01-01 00:00", 1)]).where("false")
    with pytest.raises(ValueError):
        resample.time_bounds(empty)
    with pytest.raises(ValueError):
        dst.transition_dates_for(empty, "Europe/Lisbon")


def test_raw_file_layout_quoted_header(spark, tmp_path):
    """The raw meter file: quoted header with an empty first name, quoted
    timestamps, decimal commas, a zero written without decimals."""
    text = ('"";"MT_001";"MT_002"\n'
            '"2011-01-01 00:15:00";0;2,53807106598985\n'
            '"2011-01-01 00:30:00";1,5;3\n')
    r = read_wide_text(spark, _write(tmp_path, "raw.txt", text))
    got = _sorted(r, "client_id", "ts")
    assert got == [("MT_001", T("2011-01-01 00:15"), 0.0), ("MT_001", T("2011-01-01 00:30"), 1.5),
                   ("MT_002", T("2011-01-01 00:15"), pytest.approx(2.538071, rel=1e-6)),
                   ("MT_002", T("2011-01-01 00:30"), 3.0)]


def test_decimal_point_config(spark, tmp_path):
    """With decimal "." a comma is not a decimal mark: such cells are missing."""
    path = _write(tmp_path, "dp.txt", "t;MT_1\n2011-01-01 00:00:00;1,5\n2011-01-01 00:15:00;1.5\n")
    got = [r[2] for r in _sorted(read_wide_text(spark, path, decimal="."), "ts")]
    assert got == [None, 1.5]
