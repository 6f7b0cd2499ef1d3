"""Contract queries: the library's operators run on the driver's tables, each
paired with an independent DuckDB statement that computes the same table.

Readings used (see FIXTURES.md part C):

* **E** = ``events`` as readings: ``user_id`` -> series, ``ts``, ``value``.
* **L** = ``lineitem`` as readings: ``l_suppkey`` -> series, ``l_shipdate``,
  ``l_quantity`` (daily, with duplicates, 13 Lisbon transitions).

Floating outputs are rounded half-up to 4 (values) or 6 (rates, metrics,
trigonometry) digits in both engines (trap T6).  Every query reads whole
tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import baselines
from ..functions.calendar import CALENDAR_COLS, calendar_columns
from ..functions.numeric import lenient_float, lenient_timestamp, round_half_up
from ..functions.timefns import date_text, ntz_lit
from ..operators import activity, aggregate, dst, evaluate, integrity, panel, resample
from ..operators.reshape import long_to_wide, wide_to_long
from ..schema import CLIENT, MODEL, SPLIT, TS, Y, YHAT
from ..session import checkpoint_dir
from ..sources import readers, sinks
from ..sources.readers import readings_from_table, table


@dataclass(frozen=True)
class Params:
    tz: str = "Europe/Lisbon"
    rate_min: float = 0.085
    run_max: int = 60
    bounds: panel.SplitBounds = panel.SplitBounds(
        train_end="2024-01-20 23:00:00", val_start="2024-01-21 00:00:00",
        val_end="2024-01-25 23:00:00", test_start="2024-01-26 00:00:00")
    lookback: int = 48
    chunk: int = 24
    nth_last: int = 24
    window: tuple = ("2024-01-05", "2024-01-12")
    slice_client: str = "7"
    slice_days: tuple = ("2024-01-10", "2024-01-12")
    chart_days: tuple = ("2024-01-26", "2024-01-27")
    l_rate_min: float = 0.0088
    l_run_max: int = 720


P = Params()


def r4(c):
    return round_half_up(c, 4)


def r6(c):
    return round_half_up(c, 6)


# ---------------------------------------------------------------- Spark side

def e_readings(spark: SparkSession, sf: str) -> DataFrame:
    return readings_from_table(table(spark, sf, "events"), "user_id", "ts", "value")


def l_readings(spark: SparkSession, sf: str) -> DataFrame:
    return readings_from_table(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity")


class Prepared:
    """Hourly panel, retained spine and per-series activity of a readings
    table, with the small driver-side facts (bounds, transition days)."""

    def __init__(self, readings: DataFrame, tz: str, rate_min: float, run_max: int,
                 materialize: bool = False):
        self.readings = readings
        self.hourly_all, source = resample.hourly_mean(readings), readings
        if materialize:
            # read by the statistics and the outputs: written once, so that
            # the raw table is scanned once; bounds and series come from it too
            self.hourly_all = source = sinks.stored(self.hourly_all, "hourly")
        self.clients = source.select(CLIENT)
        self.lo, self.hi = resample.time_bounds(source, hourly=True)
        self.dates = dst.transition_dates_for(readings, tz, bounds=(self.lo, self.hi))
        self.hourly = dst.drop_days(self.hourly_all, self.dates)
        self.spine = dst.drop_days(resample.hour_spine(readings, self.lo, self.hi), self.dates)
        self.stats = activity.activity_stats(
            self.hourly, self.clients, self.lo, self.hi, self.dates, rate_min, run_max)


def _e(spark, sf, materialize: bool = False) -> Prepared:
    return Prepared(e_readings(spark, sf), P.tz, P.rate_min, P.run_max, materialize)


def _l(spark, sf) -> Prepared:
    return Prepared(l_readings(spark, sf), P.tz, P.l_rate_min, P.l_run_max)


def _val(df: DataFrame) -> DataFrame:
    return df.select(CLIENT, TS, r4(Y).alias(Y))


def q_a01_dedupe_mean(spark, sf):
    return _val(resample.dedupe_mean(l_readings(spark, sf)))


def q_a02_hourly_mean(spark, sf):
    return _val(resample.hourly_mean(e_readings(spark, sf)))


def q_a03_dense_hourly(spark, sf):
    e = _e(spark, sf)
    return _val(resample.densify(e.hourly, e.spine, lo=e.lo, hi=e.hi))


def q_a04_integrity_report(spark, sf):
    r = e_readings(spark, sf)
    return integrity.integrity_report(resample.dedupe_mean(r), 900, raw=r)


def q_a04_integrity_report_daily(spark, sf):
    r = l_readings(spark, sf)
    return integrity.integrity_report(resample.dedupe_mean(r), 86_400, raw=r)


def q_w01_irregular_steps(spark, sf):
    return integrity.irregular_steps(e_readings(spark, sf), 900)


def q_w01_irregular_steps_daily(spark, sf):
    return integrity.irregular_steps(l_readings(spark, sf), 86_400)


def q_a05_nonzero_rate(spark, sf):
    return _e(spark, sf).stats.select(CLIENT, "nonzero_hours", r6("nonzero_rate").alias("nonzero_rate"))


def q_a06_max_zero_run(spark, sf):
    return _e(spark, sf).stats.select(CLIENT, "max_zero_run")


def _status(stats):
    return stats.select(CLIENT, F.when(F.col("active"), "active").otherwise("dropped").alias("status"))


def q_a07_active_clients(spark, sf):
    return _status(_e(spark, sf).stats)


def q_a07_active_clients_dst(spark, sf):
    s = _l(spark, sf).stats
    return s.select(CLIENT, "nonzero_hours", "max_zero_run",
                    F.when(F.col("active"), "active").otherwise("dropped").alias("status"))


def q_p06_master_long(spark, sf):
    e = _e(spark, sf, materialize=True)
    return _val(panel.select_clients(e.hourly, activity.active_clients(e.stats)))


def q_s06_master_wide(spark, sf):
    """The hourly master of the active series, one column per series in
    sorted (lexicographic) order -- the reference's main output -- written by
    the sink and read back: one row per hour and column, missing cells too."""
    e = _e(spark, sf, materialize=True)
    # the keep-list feeds both the column names and the semi join: computed once
    active = sinks.stored(activity.active_clients(e.stats), "active")
    names = [r[0] for r in active.orderBy(CLIENT).collect()]     # the columns of the wide table
    path = f"{checkpoint_dir(spark)}/s06-{uuid.uuid4().hex}"
    # values are rounded in long form, before the row gets wide
    sinks.write_master_wide(_val(panel.select_clients(e.hourly, active)), names, path)
    return readers.read_wide_cells(spark, path)


def q_s06_master_blocks(spark, sf):
    """The same master in column blocks, read back through its manifest."""
    e = _e(spark, sf, materialize=True)
    active = sinks.stored(activity.active_clients(e.stats), "active")
    path = f"{checkpoint_dir(spark)}/s06-{uuid.uuid4().hex}"
    sinks.write_master_blocks(_val(panel.select_clients(e.hourly, active)), active, path, block_size=16)
    return readers.read_master_blocks(spark, path).where(F.col(Y).isNotNull())


def q_s01_wide_text(spark, sf):
    """All readings by hour as wide text, one line per hour, read back by the lenient reader."""
    e = _e(spark, sf, materialize=True)
    path = f"{checkpoint_dir(spark)}/s01-{uuid.uuid4().hex}"
    header = sinks.write_wide_text(e.hourly, e.clients, path)
    return _val(readers.read_wide_text(spark, path, header=header))


def q_s13_split_blocks(spark, sf):
    """The split exports written by executors and read back: rows and values by split and series."""
    e = _e(spark, sf, materialize=True)
    base = f"{checkpoint_dir(spark)}/s13-{uuid.uuid4().hex}"
    sinks.write_split_exports(panel.assign_splits(e.hourly, P.bounds), e.clients, base)
    values, names = spark.read.parquet(f"{base}/wide/values"), spark.read.parquet(f"{base}/wide/manifest")
    cells = values.select(SPLIT, "block", F.posexplode("cells").alias("place", Y)).join(names, ["block", "place"])
    wide = cells.groupBy(SPLIT, CLIENT).agg(F.count(Y).alias("n_wide"), F.sum(F.col(Y).cast("double")).alias("total"))
    long = spark.read.parquet(f"{base}/long").groupBy(SPLIT, CLIENT).agg(F.count(Y).alias("n_long"))
    return wide.join(long, [SPLIT, CLIENT]).select(SPLIT, CLIENT, "n_long", "n_wide", r4("total").alias("total"))


def q_s13_calendar(spark, sf):
    """The calendar export as CSV, read back."""
    e = _e(spark, sf)
    path = f"{checkpoint_dir(spark)}/s13-{uuid.uuid4().hex}"
    sinks.write_calendar(e.spine, path)
    kinds = ", ".join(f"{c} double" for c in CALENDAR_COLS)
    back = spark.read.option("header", True).schema(f"timestamp timestamp_ntz, {kinds}").csv(path)
    return back.select(F.col("timestamp").alias(TS), *[r6(c).alias(c) for c in CALENDAR_COLS])


def q_s08_metadata_lists(spark, sf):
    """The per-series lists of a metadata document written from executors, parsed back from the text."""
    e = _e(spark, sf, materialize=True)
    stats = sinks.stored(e.stats, "client-stats")
    path = f"{checkpoint_dir(spark)}/s08-{uuid.uuid4().hex}.json"
    sinks.write_metadata(spark, {"active": None, "first": None}, path, {
        "active": stats.where("active").select(CLIENT), "first": activity.first_nonzero_text(stats).select(CLIENT, "first_nonzero")})
    entries = readers.read_metadata_entries(spark, path)
    active = entries.where(~F.col("keyed")).select(F.col("name").alias(CLIENT), F.lit(True).alias("active"))
    first = entries.where("keyed").select(F.col("name").alias(CLIENT), F.col("value").alias("first_nonzero"))
    return first.join(active, CLIENT, "left").select(CLIENT, "first_nonzero", F.coalesce("active", F.lit(False)).alias("active"))


def q_a08_incomplete_days(spark, sf):
    return activity.incomplete_days(_l(spark, sf).spine)


def q_a09_first_nonzero(spark, sf):
    return activity.first_nonzero_text(_e(spark, sf).stats)


def q_a10_aggregate_load(spark, sf):
    e = _e(spark, sf, materialize=True)
    agg = aggregate.aggregate_load(e.hourly, e.spine, keep=activity.active_clients(e.stats))
    return agg.select(TS, r4(aggregate.AGG_COL).alias(aggregate.AGG_COL))


def q_a11_dst_snapshot(spark, sf):
    r = resample.dedupe_mean(l_readings(spark, sf))
    dates = dst.transition_dates_for(r, P.tz, bounds=resample.time_bounds(r, hourly=True))
    n_clients = r.select(CLIENT).distinct().count()
    return dst.artefact_snapshot(r, dates, n_clients, slot_start_h=0, slot_end_h=24)


def q_w02_dst_dates(spark, sf):
    lo, hi = resample.time_bounds(l_readings(spark, sf), hourly=True)
    return dst.transition_dates(spark, lo.date(), hi.date(), P.tz).select(date_text("day").alias("date"))


def q_p03_drop_dst_days(spark, sf):
    return _val(_l(spark, sf).hourly)


def q_p01_window(spark, sf):
    return _val(panel.analysis_window(e_readings(spark, sf), *P.window))


def _e_splits(spark, sf) -> DataFrame:
    return panel.assign_splits(_e(spark, sf).hourly, P.bounds)


def q_p02_splits(spark, sf):
    return _e_splits(spark, sf).select(CLIENT, TS, r4(Y).alias(Y), SPLIT)


def q_u04_split_overlap(spark, sf):
    return panel.split_overlap(_e_splits(spark, sf)).agg(
        F.count(F.lit(1)).alias("overlapping_timestamps"))


def q_a16_split_profile(spark, sf):
    return panel.split_profile(_e_splits(spark, sf))


def q_p05_selected_clients(spark, sf):
    s = _e_splits(spark, sf)
    train_ids = s.where(F.col(SPLIT) == "train").select(CLIENT)
    return _val(panel.select_clients(s.where(F.col(SPLIT) == "test"), train_ids))


def q_p07_client_slice(spark, sf):
    return _val(panel.client_slice(_e(spark, sf).hourly, P.slice_client, *P.slice_days))


def q_a17_clients(spark, sf):
    return panel.client_list(e_readings(spark, sf))


def _event_types(events: DataFrame) -> list[str]:
    """Pivot column names: the distinct values, i.e. the columns of the wide table."""
    vals = [r[0] for r in events.select("event_type").distinct().collect()]
    return sorted(v for v in vals if v is not None)


def _by_type_long(spark, sf) -> tuple[DataFrame, list[str]]:
    ev = table(spark, sf, "events")
    types = _event_types(ev)
    long = readings_from_table(ev, "event_type", "ts", "value")
    hourly = long.groupBy(CLIENT, F.window(TS, "1 hour").start.alias(TS)).agg(
        F.sum(F.col(Y).cast("double")).alias(Y))
    return hourly, types


def q_r02_pivot(spark, sf):
    hourly, types = _by_type_long(spark, sf)
    return long_to_wide(hourly.select(CLIENT, TS, r4(Y).alias(Y)), types)


def q_r01_unpivot(spark, sf):
    hourly, types = _by_type_long(spark, sf)
    wide = long_to_wide(hourly.select(CLIENT, TS, r4(Y).alias(Y)), types)
    return _val(wide_to_long(wide, types))


def q_x02_calendar(spark, sf):
    cal = calendar_columns(TS)
    spine = _e(spark, sf).spine
    return spine.select(TS, *[(cal[c] if c == "is_weekend" else r6(cal[c])).alias(c)
                              for c in CALENDAR_COLS])


def q_j01_calendar_join(spark, sf):
    e = _e(spark, sf)
    cal = calendar_columns(TS)
    cal_tab = e.spine.select(TS, *[(cal[c] if c == "is_weekend" else r6(cal[c])).alias(c)
                                   for c in CALENDAR_COLS])
    # the calendar has one row per hour of the range: AQE broadcasts it when
    # it is small, and falls back to a shuffle join when it is not
    return e.hourly.join(cal_tab, TS, "left").select(CLIENT, TS, r4(Y).alias(Y), *CALENDAR_COLS)


def _train(spark, sf):
    return _e_splits(spark, sf).where(F.col(SPLIT) == "train").drop(SPLIT)


def q_w04_lookback(spark, sf):
    return _val(panel.lookback(_train(spark, sf), P.lookback))


def q_w05_chunks(spark, sf):
    test = _e_splits(spark, sf).where(F.col(SPLIT) == "test")
    return panel.chunk_index(test, P.chunk)


def q_w06_nth_last(spark, sf):
    return panel.nth_last_timestamp(_train(spark, sf), P.nth_last)


def q_a18_cutoff(spark, sf):
    return panel.in_sample_cutoff(_train(spark, sf), P.nth_last)


def q_a15_horizon(spark, sf):
    s = _e_splits(spark, sf)
    return s.groupBy(SPLIT).agg(F.count_distinct(TS).alias("horizon"))


def q_f07_future_axis(spark, sf):
    """F7 by count: the hours after each series' last train hour, as many as
    the validation split has distinct hours."""
    from ..forecast.jobs import future_axis
    s = _e_splits(spark, sf)
    train = s.where(F.col(SPLIT) == "train")
    return future_axis(train, hours=panel.horizon(s.where(F.col(SPLIT) == "validation")))


def q_u01_train_val(spark, sf):
    s = _e_splits(spark, sf)
    tv = panel.union_history(s.where(F.col(SPLIT) == "train"), s.where(F.col(SPLIT) == "validation"))
    return _val(panel.lookback(tv.drop(SPLIT), P.lookback))


def q_u03_remaining(spark, sf):
    s = _e_splits(spark, sf)
    wanted = s.where(F.col(SPLIT) == "test").select(TS).distinct()
    _, last_hist = resample.time_bounds(s.where(F.col(SPLIT) != "test"))
    # the first rolling round covers the hours up to last history + chunk
    end = ntz_lit(last_hist) + F.make_interval(hours=F.lit(P.lookback))
    first_round = wanted.where(F.col(TS) <= end)
    return panel.remaining_timestamps(wanted, first_round)


# ------------------------------------------------------- evaluation queries

class Scoring:
    """Test actuals and two SQL-expressible stand-in forecasts over the dense
    test axis of every series: ``hod_mean`` (train mean by hour of day,
    falling back to the train mean) and ``last_value`` (last train value)."""

    MODELS = ["hod_mean", "last_value"]

    def __init__(self, spark, sf):
        e = _e(spark, sf)
        s = panel.assign_splits(e.hourly, P.bounds)
        self.train = s.where(F.col(SPLIT) == "train").drop(SPLIT)
        self.test = s.where(F.col(SPLIT) == "test").drop(SPLIT)
        test_spine = panel.split_part(e.spine, P.bounds, "test")
        # bounds of the test hours from known facts (no job); removed days
        # inside them are dropped by the semi join on the spine
        lo = max(e.lo, dt.datetime.fromisoformat(P.bounds.test_start))
        hi = e.hi
        ids = e.readings.select(CLIENT).distinct()
        self.axis = resample.series_axis(ids, test_spine, lo, hi)
        self.dense_test = resample.densify(self.test, test_spine, ids, lo, hi)
        self.preds = panel.union_history(
            baselines.hour_of_day_mean(self.train, self.axis).withColumn(MODEL, F.lit("hod_mean")),
            baselines.last_value(self.train, self.axis).withColumn(MODEL, F.lit("last_value")))


def _metric_cols(digits=6):
    return [round_half_up(F.col(c), digits).alias(c) for c in ("MSE", "MAE", "WAPE")]


def q_a12_metrics(spark, sf):
    s = Scoring(spark, sf)
    pairs = evaluate.scored(s.test, s.preds.where(F.col(MODEL) == "hod_mean").drop(MODEL))
    return evaluate.metrics_table(pairs, null_safe=False, digits=4)


def q_a13_metrics_nullsafe(spark, sf):
    s = Scoring(spark, sf)
    pairs = s.dense_test.join(s.preds.where(F.col(MODEL) == "last_value").drop(MODEL),
                              [CLIENT, TS], "left")
    m = evaluate.metrics_table(pairs, null_safe=True)
    return m.select(CLIENT, *_metric_cols())


def q_a14_by_model(spark, sf):
    s = Scoring(spark, sf)
    m = evaluate.metrics_by_model(s.test, s.preds)
    return m.select(MODEL, CLIENT, *_metric_cols())


def q_a20_leaderboard(spark, sf):
    s = Scoring(spark, sf)
    lb = evaluate.leaderboard(evaluate.metrics_by_model(s.test, s.preds))
    return lb.select(MODEL, *_metric_cols(), "rank")


def q_a20_worst_series(spark, sf):
    s = Scoring(spark, sf)
    m = evaluate.metrics_by_model(s.test, s.preds)
    w = evaluate.worst_series(m, k=3, by="MSE")
    return w.select(MODEL, CLIENT, *_metric_cols(), "rank")


def q_p13_keep_timestamps(spark, sf):
    s = Scoring(spark, sf)
    wanted = s.test.where(F.col(CLIENT) == P.slice_client).select(TS)
    return _val(panel.keep_timestamps(s.test, wanted))


def q_j02_scored(spark, sf):
    s = Scoring(spark, sf)
    pairs = evaluate.scored(s.test, s.preds.where(F.col(MODEL) == "hod_mean").drop(MODEL))
    return pairs.select(CLIENT, TS, r4(Y).alias(Y), r4(YHAT).alias(YHAT))


def q_j03_wide_models(spark, sf):
    s = Scoring(spark, sf)
    w = evaluate.wide_by_model(s.test, s.preds, Scoring.MODELS)
    return w.select(CLIENT, TS, r4(Y).alias(Y), *[r4(m).alias(m) for m in Scoring.MODELS])


def q_j04_in_sample(spark, sf):
    s = Scoring(spark, sf)
    fitted = baselines.hour_of_day_mean(s.train, s.train.select(CLIENT, TS))
    pairs = evaluate.in_sample_pairs(s.train, fitted)
    return pairs.select(CLIENT, TS, r4(Y).alias(Y), r4(YHAT).alias(YHAT))


def q_f13_actual_vs_predicted(spark, sf):
    s = Scoring(spark, sf)
    out = evaluate.actual_vs_predicted(s.test, s.preds, P.slice_client, *P.chart_days)
    return out.select(CLIENT, TS, r4(Y).alias(Y), MODEL, r4(YHAT).alias(YHAT))


# --------------------------------------------------------- lenient parsing

def _text_events(spark, sf) -> DataFrame:
    """Events written out as text cells: signups get a broken timestamp,
    clicks a decimal comma, errors a non-number, the rest a decimal point."""
    ev = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    whole = F.floor(cents / 100).cast("long").cast("string")
    ts_txt = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.select(
        F.col("user_id").cast("string").alias(CLIENT), "event_type",
        F.when(F.col("event_type") == "signup", F.concat(F.lit("bad "), ts_txt)).otherwise(ts_txt).alias("ts_txt"),
        F.when(F.col("event_type") == "click", F.concat_ws(",", whole, frac))
         .when(F.col("event_type") == "error", F.lit("n/a"))
         .otherwise(F.concat_ws(".", whole, frac)).alias("y_txt"))


def q_s03_lenient_parse(spark, sf):
    t = _text_events(spark, sf)
    parsed = t.select(CLIENT, lenient_timestamp("ts_txt").alias(TS), lenient_float("y_txt").alias(Y))
    return _val(parsed.where(F.col(TS).isNotNull()))


def q_s04_lenient_numeric(spark, sf):
    t = _text_events(spark, sf).withColumn(Y, lenient_float("y_txt"))
    return t.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col(Y).isNull()).alias("missing"),
        r4(F.sum(F.col(Y).cast("double"))).alias("total"))


# ------------------------------------------------------------- SQL oracle

def _r(expr: str, d: int = 4) -> str:
    s = 10 ** d
    return f"(floor(cast(({expr}) as double) * {s} + 0.5) / {s} + 0.0)"


E_RAW = "select cast(user_id as varchar) as client_id, ts, cast(value as float) as y from events"
L_RAW = ("select cast(l_suppkey as varchar) as client_id, l_shipdate as ts, "
         "cast(l_quantity as float) as y from lineitem")


def _dedup(raw: str) -> str:
    return f"select client_id, ts, cast(avg(y) as float) as y from ({raw}) group by client_id, ts"


def _hourly(raw: str) -> str:
    return (f"select client_id, h as ts, cast(avg(y) as float) as y from "
            f"(select client_id, date_trunc('hour', ts) as h, y from ({_dedup(raw)})) "
            f"group by client_id, h")


def _off(expr: str) -> str:
    return f"(epoch({expr}) - epoch(timezone('{P.tz}', {expr})))"


def _prep_ctes(raw: str) -> str:
    """raw, hourly (all), dst days, hourly (kept), spine (kept), clients."""
    noon = "(day::timestamp + interval 12 hour)"
    prev = "(day::timestamp - interval 12 hour)"
    return f"""
raw as ({raw}),
hall as ({_hourly("select * from raw")}),
bnd as (select min(ts) as lo, max(ts) as hi from hall),
days as (select unnest(generate_series((select lo from bnd)::date, (select hi from bnd)::date, interval 1 day))::date as day),
dd as (select day from days where day > (select lo from bnd)::date and {_off(noon)} <> {_off(prev)}),
hourly as (select * from hall where cast(ts as date) not in (select day from dd)),
spine as (select ts from (select unnest(generate_series((select lo from bnd), (select hi from bnd), interval 1 hour)) as ts)
          where cast(ts as date) not in (select day from dd)),
clients as (select distinct client_id from raw)"""


def _activity_ctes(raw: str, rate_min: float, run_max: int) -> str:
    return _prep_ctes(raw) + f""",
dense as (select c.client_id, s.ts, coalesce(h.y, 0) <> 0 as nz
          from clients c cross join spine s left join hourly h on h.client_id = c.client_id and h.ts = s.ts),
isl as (select client_id, nz, row_number() over (partition by client_id order by ts)
               - row_number() over (partition by client_id, nz order by ts) as grp from dense),
runs as (select client_id, max(n) as run from (select client_id, grp, count(*) as n from isl where not nz group by 1, 2) group by 1),
st as (select d.client_id, count(*) filter (where nz) as nonzero_hours, avg(nz::int) as rate,
              coalesce(max(r.run), 0) as max_zero_run
       from dense d left join runs r on r.client_id = d.client_id group by d.client_id),
stats as (select *, case when rate >= {rate_min} and max_zero_run <= {run_max} then 'active' else 'dropped' end as status from st)"""


def _e_act() -> str:
    return _activity_ctes(E_RAW, P.rate_min, P.run_max)


def _splits_sql() -> str:
    b = P.bounds
    return (f"case when ts <= timestamp '{b.train_end}' then 'train' "
            f"when ts >= timestamp '{b.val_start}' and ts <= timestamp '{b.val_end}' then 'validation' "
            f"when ts >= timestamp '{b.test_start}' then 'test' end")


def _e_split_ctes() -> str:
    return _prep_ctes(E_RAW) + f""",
sp as (select client_id, ts, y, {_splits_sql()} as split from hourly),
train as (select client_id, ts, y from sp where split = 'train'),
test as (select client_id, ts, y from sp where split = 'test')"""


def _scoring_ctes() -> str:
    return _e_split_ctes() + """,
tspine as (select ts from spine where """ + f"ts >= timestamp '{P.bounds.test_start}')," + """
axis as (select c.client_id, t.ts from clients c cross join tspine t),
hod as (select client_id, hour(ts) as hr, avg(y) as m from train group by 1, 2),
tmean as (select client_id, avg(y) as m from train group by 1),
lastv as (select client_id, arg_max(y, ts) as v from train group by 1),
preds as (
  select 'hod_mean' as model, a.client_id, a.ts, coalesce(h.m, t.m) as yhat
  from axis a left join hod h on h.client_id = a.client_id and h.hr = hour(a.ts)
              left join tmean t on t.client_id = a.client_id
  union all
  select 'last_value', a.client_id, a.ts, cast(l.v as double) from axis a left join lastv l on l.client_id = a.client_id),
dtest as (select a.client_id, a.ts, t.y from axis a left join test t on t.client_id = a.client_id and t.ts = a.ts)"""


def _metrics_sql(pairs: str, keys: str, null_safe: bool, d: int | None) -> str:
    """Per-``keys`` + client metrics plus OVERALL per ``keys`` over ``pairs``."""
    kc = f"{keys}, " if keys else ""
    ok = "y is not null and yhat is not null"
    body = f"""
  count(*) as rws, count(*) filter (where {ok}) as n,
  sum(case when {ok} then (cast(y as double) - yhat) * (cast(y as double) - yhat) end) as sq,
  sum(case when {ok} then abs(cast(y as double) - yhat) end) as ab,
  sum(case when {ok} then abs(cast(y as double)) end) as den"""
    agg = f"""
select {kc}client_id, {body} from ({pairs}) group by {kc}client_id
union all
select {kc}'OVERALL', {body} from ({pairs}) {'group by ' + keys if keys else ''}"""
    guard = "" if null_safe else "case when rws = n then "
    end = "" if null_safe else " end"

    def m(e):
        v = f"{guard}{e}{end}"
        return _r(v, d) if d is not None else v
    return f"""select {kc}client_id,
  {m('sq / nullif(n, 0)')} as MSE, {m('ab / nullif(n, 0)')} as MAE, {m('ab / nullif(den, 0)')} as WAPE
from ({agg})"""


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["a01_dedupe_mean"] = f"select client_id, ts, {_r('y')} as y from ({_dedup(L_RAW)})"
    q["a02_hourly_mean"] = f"select client_id, ts, {_r('y')} as y from ({_hourly(E_RAW)})"
    q["a03_dense_hourly"] = f"""with {_prep_ctes(E_RAW)}
select c.client_id, s.ts, {_r('h.y')} as y from clients c cross join spine s
left join hourly h on h.client_id = c.client_id and h.ts = s.ts"""

    def integ(raw, step):
        return f"""with raw as ({raw}), ax as (select distinct ts from raw),
st as (select ts, lag(ts) over (order by ts) as p from ax)
select (select count(*) from ax) as "rows",
  (select count(distinct client_id) from raw) as clients,
  strftime((select min(ts) from ax), '%Y-%m-%d %H:%M:%S') as "start",
  strftime((select max(ts) from ax), '%Y-%m-%d %H:%M:%S') as "end",
  cast(0 as bigint) as duplicate_timestamps,
  (select count(*) from st where p is not null and epoch_us(ts) - epoch_us(p) <> {step * 1_000_000}) as non_15m_intervals,
  (select cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from raw group by client_id, ts)) as raw_duplicate_readings"""
    q["a04_integrity_report"] = integ(E_RAW, 900)
    q["a04_integrity_report_daily"] = integ(L_RAW, 86_400)
    def steps(raw, step):
        return f"""with ax as (select distinct ts from ({raw})),
st as (select ts, lag(ts) over (order by ts) as prev_ts from ax)
select ts, prev_ts, (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 as step_seconds
from st where prev_ts is not null and epoch_us(ts) - epoch_us(prev_ts) <> {step * 1_000_000}"""
    q["w01_irregular_steps"] = steps(E_RAW, 900)
    q["w01_irregular_steps_daily"] = steps(L_RAW, 86_400)
    q["a05_nonzero_rate"] = f"""with {_e_act()}
select client_id, nonzero_hours, {_r('rate', 6)} as nonzero_rate from stats"""
    q["a06_max_zero_run"] = f"with {_e_act()}\nselect client_id, max_zero_run from stats"
    q["a07_active_clients"] = f"with {_e_act()}\nselect client_id, status from stats"
    q["a07_active_clients_dst"] = f"""with {_activity_ctes(L_RAW, P.l_rate_min, P.l_run_max)}
select client_id, nonzero_hours, max_zero_run, status from stats"""
    q["p06_master_long"] = f"""with {_e_act()}
select client_id, ts, {_r('y')} as y from hourly where client_id in (select client_id from stats where status = 'active')"""
    q["s06_master_wide"] = f"""with {_e_act()},
act as (select client_id, ts, {_r('y')} as y from hourly where client_id in (select client_id from stats where status = 'active'))
select h.ts, n.ordinal, n.client_id, a.y
from (select distinct ts from act) h
cross join (select client_id, cast(row_number() over (order by client_id) as integer) as ordinal
            from stats where status = 'active') n
left join act a on a.ts = h.ts and a.client_id = n.client_id"""
    q["s06_master_blocks"] = f"""with {_e_act()}
select client_id, ts, {_r('y')} as y from hourly where y is not null and client_id in (select client_id from stats where status = 'active')"""
    q["s01_wide_text"] = f"""with {_prep_ctes(E_RAW)}
select c.client_id, h.ts, {_r('a.y')} as y from (select distinct ts from hourly) h cross join clients c
left join hourly a on a.ts = h.ts and a.client_id = c.client_id"""
    q["s13_split_blocks"] = f"""with {_prep_ctes(E_RAW)}, sp as (select *, {_splits_sql()} as split from hourly)
select split, client_id, count(y) as n_long, count(y) as n_wide, {_r('sum(cast(y as double))')} as total from sp
where split is not null group by 1, 2"""
    q["s13_calendar"] = f"""with {_prep_ctes(E_RAW)}
select ts, {_r('sin(2 * pi() * hour(ts) / 24)', 6)} as hour_sin, {_r('cos(2 * pi() * hour(ts) / 24)', 6)} as hour_cos,
  {_r('sin(2 * pi() * (isodow(ts) - 1) / 7)', 6)} as dow_sin, {_r('cos(2 * pi() * (isodow(ts) - 1) / 7)', 6)} as dow_cos,
  {_r('case when isodow(ts) >= 6 then 1.0 else 0.0 end', 6)} as is_weekend,
  {_r('sin(2 * pi() * month(ts) / 12)', 6)} as month_sin, {_r('cos(2 * pi() * month(ts) / 12)', 6)} as month_cos from spine"""
    q["s08_metadata_lists"] = f"""with {_e_act()}
select s.client_id, f.first_nonzero, s.status = 'active' as active from stats s join (
  select c.client_id, strftime(min(h.ts) filter (where h.y <> 0), '%Y-%m-%d %H:%M:%S') as first_nonzero
  from clients c left join hourly h on h.client_id = c.client_id group by c.client_id) f using (client_id)"""
    q["a08_incomplete_days"] = f"""with {_prep_ctes(L_RAW)}
select strftime(cast(ts as date), '%Y-%m-%d') as date, count(*) as hours from spine
group by cast(ts as date) having count(*) <> 24"""
    q["a09_first_nonzero"] = f"""with {_prep_ctes(E_RAW)}
select c.client_id, strftime(min(h.ts) filter (where h.y <> 0), '%Y-%m-%d %H:%M:%S') as first_nonzero
from clients c left join hourly h on h.client_id = c.client_id group by c.client_id"""
    q["a10_aggregate_load"] = f"""with {_e_act()},
tot as (select ts, sum(cast(y as double)) as s from hourly where client_id in (select client_id from stats where status = 'active') group by ts)
select s.ts, {_r('coalesce(t.s, 0.0)')} as aggregate_hourly_kW from spine s left join tot t on t.ts = s.ts"""
    q["a11_dst_snapshot"] = f"""with {_prep_ctes(L_RAW)},
dedup as ({_dedup("select * from raw")}),
nc as (select count(distinct client_id) as n from dedup),
per_ts as (select ts, count(*) filter (where y = 0) as zeros from dedup
           where cast(ts as date) in (select day from dd) group by ts),
per_day as (select cast(ts as date) as day, count(*)::double as r,
                   avg(case when zeros = (select n from nc) then 1.0 else 0.0 end) as z from per_ts group by 1)
select strftime(dd.day, '%Y-%m-%d') as date, coalesce(r, 0.0) as rows_01_to_02,
       coalesce(z, 0.0) as all_client_zero_row_rate from dd left join per_day using (day)"""
    q["w02_dst_dates"] = f"with {_prep_ctes(L_RAW)}\nselect strftime(day, '%Y-%m-%d') as date from dd"
    q["p03_drop_dst_days"] = f"with {_prep_ctes(L_RAW)}\nselect client_id, ts, {_r('y')} as y from hourly"
    w0, w1 = P.window
    q["p01_window"] = f"""select client_id, ts, {_r('y')} as y from ({E_RAW})
where ts >= timestamp '{w0} 00:00:00' and ts <= timestamp '{w1} 00:00:00' + interval 1 day - interval 1 second"""
    q["p02_splits"] = f"with {_e_split_ctes()}\nselect client_id, ts, {_r('y')} as y, split from sp where split is not null"
    q["u04_split_overlap"] = f"""with {_e_split_ctes()}
select count(*) as overlapping_timestamps from (select ts from (select distinct split, ts from sp where split is not null)
group by ts having count(*) > 1)"""
    q["a16_split_profile"] = f"""with {_e_split_ctes()}
select split, count(*) as "rows", count(distinct client_id) as series, count(distinct ts) as timestamps,
       min(ts) as "start", max(ts) as "end" from sp where split is not null group by split"""
    q["p05_selected_clients"] = f"""with {_e_split_ctes()}
select client_id, ts, {_r('y')} as y from test where client_id in (select client_id from train)"""
    c0, c1 = P.slice_days
    q["p07_client_slice"] = f"""with {_prep_ctes(E_RAW)}
select client_id, ts, {_r('y')} as y from hourly where client_id = '{P.slice_client}'
and cast(ts as date) between date '{c0}' and date '{c1}'"""
    q["a17_clients"] = f"select distinct client_id from ({E_RAW})"
    types = ["click", "error", "purchase", "signup", "view"]
    by_type = ("select event_type, date_trunc('hour', ts) as ts, sum(cast(cast(value as float) as double)) as v "
               "from events group by 1, 2")
    piv = ", ".join(f"{_r(f'sum(v) filter (where event_type = {chr(39)}{t}{chr(39)})')} as {t}" for t in types)
    q["r02_pivot"] = f"select ts, {piv} from ({by_type}) group by ts"
    q["r01_unpivot"] = f"""with w as (select ts, {piv} from ({by_type}) group by ts)
select client_id, ts, {_r('cast(y as float)')} as y from w unpivot include nulls (y for client_id in ({", ".join(types)}))"""
    dow = "(isodow(ts) - 1)"          # Monday = 0
    trig = [("hour_sin", "sin", "hour(ts)", 24), ("hour_cos", "cos", "hour(ts)", 24),
            ("dow_sin", "sin", dow, 7), ("dow_cos", "cos", dow, 7),
            ("month_sin", "sin", "month(ts)", 12), ("month_cos", "cos", "month(ts)", 12)]
    cal_cols = {name: f"{_r(f'{fn}(2 * pi() * {arg} / {period})', 6)} as {name}"
                for name, fn, arg, period in trig}
    cal_cols["is_weekend"] = f"cast({dow} >= 5 as integer) as is_weekend"
    cal_sql = ", ".join(cal_cols[c] for c in CALENDAR_COLS)
    q["x02_calendar"] = f"with {_prep_ctes(E_RAW)}\nselect ts, {cal_sql} from spine"
    q["j01_calendar_join"] = f"""with {_prep_ctes(E_RAW)}, cal as (select ts, {cal_sql} from spine)
select h.client_id, h.ts, {_r('h.y')} as y, {", ".join("cal." + c for c in CALENDAR_COLS)}
from hourly h left join cal on cal.ts = h.ts"""
    q["w04_lookback"] = f"""with {_e_split_ctes()}
select client_id, ts, {_r('y')} as y from train qualify row_number() over (partition by client_id order by ts desc) <= {P.lookback}"""
    q["w05_chunks"] = f"""with {_e_split_ctes()}
select ts, pos, cast(floor(pos / {P.chunk}) as bigint) as chunk from
(select ts, row_number() over (order by ts) - 1 as pos from (select distinct ts from test))"""
    q["w06_nth_last"] = f"""with {_e_split_ctes()}
select client_id, ts from train qualify row_number() over (partition by client_id order by ts desc) = {P.nth_last}"""
    q["a18_cutoff"] = f"""with {_e_split_ctes()}
select min(ts) as cutoff from (select ts from train qualify row_number() over (partition by client_id order by ts desc) = {P.nth_last})"""
    q["a15_horizon"] = f"""with {_e_split_ctes()}
select split, count(distinct ts) as horizon from sp where split is not null group by split"""
    q["f07_future_axis"] = f"""with {_e_split_ctes()},
h as (select count(distinct ts) as n from sp where split = 'validation'),
last as (select client_id, max(ts) as m from train group by client_id)
select client_id, unnest(generate_series(m + interval 1 hour, m + to_hours((select n from h)), interval 1 hour)) as ts
from last"""
    q["u01_train_val"] = f"""with {_e_split_ctes()}
select client_id, ts, {_r('y')} as y from sp where split in ('train', 'validation')
qualify row_number() over (partition by client_id order by ts desc) <= {P.lookback}"""
    q["u03_remaining"] = f"""with {_e_split_ctes()}
select distinct ts from test where ts > (select max(ts) from sp where split <> 'test') + interval {P.lookback} hour"""
    q["a12_metrics"] = f"""with {_scoring_ctes()}
{_metrics_sql("select t.client_id, t.y, p.yhat from test t join preds p on p.client_id = t.client_id and p.ts = t.ts and p.model = 'hod_mean'", "", False, 4)}"""
    q["a13_metrics_nullsafe"] = f"""with {_scoring_ctes()}
select client_id, {_r('MSE', 6)} as MSE, {_r('MAE', 6)} as MAE, {_r('WAPE', 6)} as WAPE from (
{_metrics_sql("select d.client_id, d.y, p.yhat from dtest d left join preds p on p.client_id = d.client_id and p.ts = d.ts and p.model = 'last_value'", "", True, None)})"""
    q["a14_by_model"] = f"""with {_scoring_ctes()}
select model, client_id, {_r('MSE', 6)} as MSE, {_r('MAE', 6)} as MAE, {_r('WAPE', 6)} as WAPE from (
{_metrics_sql("select p.model, t.client_id, t.y, p.yhat from test t join preds p on p.client_id = t.client_id and p.ts = t.ts", "model", True, None)})"""
    q["a20_leaderboard"] = f"""with {_scoring_ctes()},
m as ({_metrics_sql("select p.model, t.client_id, t.y, p.yhat from test t join preds p on p.client_id = t.client_id and p.ts = t.ts", "model", True, None)})
select model, {_r('MSE', 6)} as MSE, {_r('MAE', 6)} as MAE, {_r('WAPE', 6)} as WAPE,
cast(rank() over (order by WAPE asc nulls last, MSE asc nulls last, model) as integer) as rank
from m where client_id = 'OVERALL'"""
    q["a20_worst_series"] = f"""with {_scoring_ctes()},
m as ({_metrics_sql("select p.model, t.client_id, t.y, p.yhat from test t join preds p on p.client_id = t.client_id and p.ts = t.ts", "model", True, None)})
select model, client_id, {_r('MSE', 6)} as MSE, {_r('MAE', 6)} as MAE, {_r('WAPE', 6)} as WAPE, rank from (
  select *, cast(row_number() over (partition by model order by MSE desc nulls last, client_id) as integer) as rank
  from m where client_id <> 'OVERALL') where rank <= 3"""
    q["p13_keep_timestamps"] = f"""with {_scoring_ctes()}
select client_id, ts, {_r('y')} as y from test where ts in (select ts from test where client_id = '{P.slice_client}')"""
    q["j02_scored"] = f"""with {_scoring_ctes()}
select t.client_id, t.ts, {_r('t.y')} as y, {_r('p.yhat')} as yhat from test t
join preds p on p.client_id = t.client_id and p.ts = t.ts and p.model = 'hod_mean'"""
    q["j03_wide_models"] = f"""with {_scoring_ctes()}
select t.client_id, t.ts, {_r('t.y')} as y, {_r('a.yhat')} as hod_mean, {_r('b.yhat')} as last_value from test t
left join preds a on a.client_id = t.client_id and a.ts = t.ts and a.model = 'hod_mean'
left join preds b on b.client_id = t.client_id and b.ts = t.ts and b.model = 'last_value'"""
    q["j04_in_sample"] = f"""with {_scoring_ctes()}
select t.client_id, t.ts, {_r('t.y')} as y, {_r('coalesce(h.m, m.m)')} as yhat from train t
left join hod h on h.client_id = t.client_id and h.hr = hour(t.ts)
left join tmean m on m.client_id = t.client_id
where t.y is not null and coalesce(h.m, m.m) is not null"""
    d0, d1 = P.chart_days
    q["f13_actual_vs_predicted"] = f"""with {_scoring_ctes()}
select t.client_id, t.ts, {_r('t.y')} as y, p.model, {_r('p.yhat')} as yhat from test t
left join preds p on p.client_id = t.client_id and p.ts = t.ts
where t.client_id = '{P.slice_client}' and cast(t.ts as date) between date '{d0}' and date '{d1}'"""
    txt = """select cast(user_id as varchar) as client_id, event_type,
  case when event_type = 'signup' then 'bad ' || strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M:%S') end as ts_txt,
  case when event_type = 'click' then cast(c // 100 as varchar) || ',' || lpad(cast(c % 100 as varchar), 2, '0')
       when event_type = 'error' then 'n/a'
       else cast(c // 100 as varchar) || '.' || lpad(cast(c % 100 as varchar), 2, '0') end as y_txt
from (select *, cast(round(value * 100) as bigint) as c from events)"""
    lenient = "try_cast(replace(trim(y_txt), ',', '.') as float)"
    q["s03_lenient_parse"] = f"""select client_id, try_cast(trim(ts_txt) as timestamp) as ts, {_r(lenient)} as y
from ({txt}) where try_cast(trim(ts_txt) as timestamp) is not null"""
    q["s04_lenient_numeric"] = f"""select event_type, count(*) as cells, count(*) filter (where y is null) as missing,
{_r('sum(cast(y as double))')} as total from (select event_type, {lenient} as y from ({txt})) group by event_type"""
    return q


SPARK_QUERIES = {name[2:]: fn for name, fn in globals().items()
                 if name.startswith("q_") and callable(fn)}


def queries() -> dict:
    return dict(SPARK_QUERIES)


def oracle_sql() -> dict[str, str]:
    sql = _sql()
    missing = set(sql) - set(SPARK_QUERIES)
    if missing:
        raise RuntimeError(f"oracle without query: {sorted(missing)}")
    return sql
