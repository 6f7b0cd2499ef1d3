"""Property test: non-zero rate, longest zero run and first non-zero hour
from the blocked Spark formulation equal a brute-force pass over the dense
retained hour axis, for random panels with removed days."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterframe.operators import activity, dst

BASE = dt.datetime(2012, 3, 1)
HOURS = 24 * 9


def _brute(rows, removed):
    axis = [BASE + dt.timedelta(hours=h) for h in range(HOURS)]
    axis = [t for t in axis if t.date() not in removed]
    out = {}
    for c in {r[0] for r in rows}:
        vals = {t: y for cc, t, y in rows if cc == c}
        nz = [t for t in axis if vals.get(t) not in (None, 0.0)]
        best = cur = 0
        for t in axis:
            if vals.get(t) in (None, 0.0):
                cur += 1
                best = max(best, cur)
            else:
                cur = 0
        out[c] = (len(nz), best, min(nz) if nz else None)
    return out


cells = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, HOURS - 1),
                           st.sampled_from([0.0, 1.0, -2.0, None])), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=cells, removed_idx=st.sets(st.integers(1, 7), max_size=2), block=st.sampled_from([5, 24, 672]))
def test_activity_matches_brute_force(spark, cells, removed_idx, block):
    removed = sorted((BASE + dt.timedelta(days=d)).date() for d in removed_idx)
    dedup = {}
    for c, h, y in cells:
        dedup[(c, BASE + dt.timedelta(hours=h))] = y
    rows = [(c, t, y) for (c, t), y in dedup.items()]
    # the panel spans the whole axis: anchor its first and last hour
    anchors = [("z", BASE, 1.0), ("z", BASE + dt.timedelta(hours=HOURS - 1), 1.0)]
    df = spark.createDataFrame(rows + anchors, "client_id string, ts timestamp_ntz, y float")
    kept = dst.drop_days(df, removed)
    old = activity.POS_BLOCK
    activity.POS_BLOCK = block
    try:
        stats = activity.activity_stats(kept, df.select("client_id"), BASE,
                                        BASE + dt.timedelta(hours=HOURS - 1), removed, 0.0, 10 ** 6)
        got = {r["client_id"]: (r["nonzero_hours"], r["max_zero_run"], r["first_nonzero_ts"])
               for r in stats.collect()}
    finally:
        activity.POS_BLOCK = old
    want = _brute([r for r in rows + anchors if r[1].date() not in removed], set(removed))
    for c, (n_nz, run, first) in want.items():
        assert got[c] == (n_nz, run, first), (c, got[c], (n_nz, run, first), removed)


stamps = st.sets(st.integers(0, 24 * 60 * 5), min_size=2, max_size=80)   # minutes over five days


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(minutes=stamps, chunk=st.sampled_from([1, 7, 50]))
def test_blocked_steps_and_positions_match_brute_force(spark, minutes, chunk):
    from meterframe.operators import integrity, panel
    ts = sorted(BASE + dt.timedelta(minutes=m) for m in minutes)
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = sorted((r["ts"], r["prev_ts"]) for r in integrity.irregular_steps(df, 900).collect())
    want = [(b, a) for a, b in zip(ts, ts[1:]) if (b - a) != dt.timedelta(minutes=15)]
    assert got == want
    pos = {r["ts"]: (r["pos"], r["chunk"]) for r in panel.chunk_index(df, chunk).collect()}
    assert pos == {t: (i, i // chunk) for i, t in enumerate(ts)}
