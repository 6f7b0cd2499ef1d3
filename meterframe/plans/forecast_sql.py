"""DuckDB statements for the forecasting queries: the same models written
independently with lists and recursive CTEs (elimination, states of the
smoothing, forecast paths)."""

from __future__ import annotations

from ..forecast import additive, arima, smoothing
from .contract import E_RAW, L_RAW, P, _hourly, _metrics_sql, _prep_ctes, _r, _splits_sql

LOOKBACK = 672


def _panel() -> str:
    return _prep_ctes(E_RAW) + f""",
pan as (select *, {_splits_sql()} as split from (
        select c.client_id, s.ts, cast(cast(coalesce(h.y, 0) as float) as double) as y
        from clients c cross join spine s left join hourly h on h.client_id = c.client_id and h.ts = s.ts))"""


def _part(name: str, splits: tuple) -> str:
    listed = ", ".join(f"'{s}'" for s in splits)
    return f"{name} as (select client_id, ts, y from pan where split in ({listed}))"


def _hours(name: str, split: str, history: str, mode: str) -> str:
    """One row: the number of hours ahead, the same for all series here."""
    if mode == "count":
        return f"{name} as (select count(distinct ts) as h from pan where split = '{split}')"
    return (f"{name} as (select date_diff('hour', (select max(ts) from {history}), max(ts)) as h "
            f"from pan where split = '{split}')")


def _series(p: str, history: str, lookback: int = LOOKBACK) -> str:
    return f"""
{p}s as (select client_id, max(ts) as last_ts, count(*) as n, list(y order by ts) as y, list(ts order by ts) as t
         from (select *, row_number() over (partition by client_id order by ts desc) as rn from {history})
         where rn <= {lookback} group by client_id)"""


def _solve(p: str, src: str) -> str:
    """``{p}(k, beta)``: solutions of the systems ``src(k, n, i, row)`` by
    elimination; dependent columns get 0."""
    return f"""
{p}_r(k, n, i, step, diag, row) as (
  select k, n, i, 0, row[i], row from {src}
  union all
  select k, n, i, step + 1, diag,
         case when i = step + 1 then pr else list_transform(range(1, len(pr) + 1), lambda j: row[j + 1] - row[1] * pr[j]) end
  from (select *, max(mine) over (partition by k) as pr
        from (select *, case when i = step + 1 then
                list_transform(row[2:], lambda v: case when abs(row[1]) > 1e-9 * abs(diag) then v / row[1] else 0.0 end) end as mine
              from {p}_r where step < n))),
{p} as (select k, list(row[1] order by i) as beta from {p}_r where step = n group by k)"""


# ------------------------------------------------------------------- additive

def _additive_columns(ts: str, h: str, seasons) -> str:
    s = additive.Settings()
    t = f"(({h} - h0) / sp)"
    cols = ["1.0", t]
    cols += [f"greatest({t} - {s.trend_range / (s.changepoints + 1) * j!r}, 0.0)" for j in range(1, s.changepoints + 1)]
    for period, order in seasons:
        for k in range(1, order + 1):
            cols += [f"{f}({h} * {2 * k} * pi() / {period!r})" for f in ("sin", "cos")]
    cols.append(f"case when isodow({ts}) >= 6 then 1.0 else 0.0 end")
    return "[" + ", ".join(f"cast({c} as double)" for c in cols) + "]"


def _additive(p: str, history: str, seasons) -> str:
    s = additive.Settings()
    n = 2 + s.changepoints + sum(2 * k for _, k in seasons) + 1
    penalty = f"case when i between 3 and {2 + s.changepoints} then {s.trend_penalty!r} " \
              f"when i between {3 + s.changepoints} and {n - 1} then {s.season_penalty!r} else 1e-9 end"
    return f"""
{p}b as (select client_id, max(ts) as last_ts, min(epoch(ts)) / 3600.0 as h0,
                greatest((max(epoch(ts)) - min(epoch(ts))) / 3600.0, 1.0) as sp from {history} group by client_id),
{p}d as (select client_id, list_append({_additive_columns('ts', '(epoch(ts) / 3600.0)', seasons)}, y) as x
         from {history} join {p}b using (client_id)),
{p}ij as (select i, j from range(1, {n + 1}) a(i), range(1, {n + 2}) b(j) where j >= i),
{p}u as (select client_id, i, j, sum(x[i] * x[j]) as v from {p}d, {p}ij group by 1, 2, 3),
{p}f as (select client_id, i, j, v + case when i = j then {penalty} else 0 end as v from {p}u
         union all select client_id, j, i, v from {p}u where i < j and j <= {n}),
{p}a as (select client_id as k, {n} as n, i, list(v order by j) as row from {p}f group by client_id, i),
{_solve(p + 'x', p + 'a')}"""


# ------------------------------------------------------------------ smoothing

def _ets_fold(p: str, src: str, grid: str, s: smoothing.Settings) -> str:
    """``{p}(client_id, i, ...)``: last state and score of every row of ``grid``
    (client_id, i, trend, seasonal, a, b, c, p, k)."""
    m = s.period
    return f"""
{p}_r(client_id, i, step, nxt, d, s, sse) using key (client_id, i) as (
  select v.client_id, g.i, 0,
         (case when seasonal = 1 then m1 else y[1] end) + g.p * b0, g.p * b0,
         case when seasonal = 1 then list_transform(y[1:{m}], lambda q: q - m1) else cast([] as double[]) end, cast(0 as double)
  from (select *, case when trend = 0 then 0.0 when seasonal = 1 then (m2 - m1) / {m} else y[2] - y[1] end as b0
        from {grid} join (select client_id, y, list_avg(y[1:{m}]) as m1, list_avg(y[{m + 1}:{2 * m}]) as m2 from {src})
             using (client_id)) g join (select client_id from {src}) v using (client_id)
  union
  select client_id, i, step + 1, nxt + p * d + (a + p * b) * e, p * d + p * b * e,
         case when seasonal = 1 then list_append(s[2:], s[1] + c * e) else s end, sse + e * e
  from (select r.*, g.trend, g.seasonal, g.a, g.b, g.c, g.p,
               v.y[step + 1] - nxt - case when g.seasonal = 1 then s[1] else 0 end as e
        from {p}_r r join {grid} g using (client_id, i) join {src} v using (client_id) where r.step < v.n)),
{p} as (select r.client_id, r.i, r.nxt, r.d, r.s, g.trend, g.seasonal, g.a, g.b, g.c, g.p, g.k,
               row_number() over (partition by r.client_id order by n - g.k - 1 <= 0,
                 round(n * ln(greatest(r.sse / n, {s.least!r})) + 2 * g.k + 2.0 * g.k * (g.k + 1) / greatest(n - g.k - 1, 1), 9),
                 r.i) as place
        from {p}_r r join {grid} g using (client_id, i) join {src} v using (client_id))"""


def _ets(p: str, src: str, hours: str) -> str:
    s = smoothing.Settings()
    rows = ", ".join(f"({i}, {r['trend']}, {r['seasonal']}, {r['a']!r}, {r['b']!r}, {r['c']!r}, {r['p']!r}, {r['k']})"
                     for i, r in enumerate(smoothing.grid(s)))
    listed = lambda x: "[" + ", ".join(map(repr, x)) + "]"
    return f"""
{p}g as (select client_id, v.* from (select client_id from {src}),
         (select i, trend, seasonal, cast(a as double) as a, cast(b as double) as b, cast(c as double) as c,
                 cast(p as double) as p, k from (values {rows}) t(i, trend, seasonal, a, b, c, p, k)) v),
{_ets_fold(p + 'c', src, p + 'g', s)},
{p}h as (select client_id, ia * 9 + ib * 3 + ic as i, trend, seasonal, a2 as a, least(b * fb, a2) as b, least(c * fc, 1 - a2) as c, p, k
         from (select *, least(a * fa, 0.999) as a2 from {p}c,
               (select ia, cast({listed(s.finer_level)}[ia + 1] as double) as fa from range(0, {len(s.finer_level)}) t(ia)),
               (select ib, cast({listed(s.finer)}[ib + 1] as double) as fb from range(0, {len(s.finer)}) t(ib)),
               (select ic, cast({listed(s.finer)}[ic + 1] as double) as fc from range(0, {len(s.finer)}) t(ic))
               where place = 1 and (trend > 0 or ib = 1) and (seasonal = 1 or ic = 1))),
{_ets_fold(p + 'f', src, p + 'h', s)},
{p}p as (select 'ets' as model, client_id, last_ts + to_hours(cast(step as integer)) as ts,
                nxt + case trend when 0 then 0 when 1 then (step - 1) * d else p * (1 - pow(p, step - 1)) / (1 - p) * d end
                + case when seasonal = 1 then s[(step - 1) % {s.period} + 1] else 0 end as yhat
         from {p}f join {src} using (client_id), (select unnest(range(1, (select h from {hours}) + 1)) as step) where place = 1)"""


# ---------------------------------------------------------------------- arima

_CALENDAR = ["sin(2 * pi() * hour({t}) / 24)", "cos(2 * pi() * hour({t}) / 24)",
             "sin(2 * pi() * (isodow({t}) - 1) / 7)", "cos(2 * pi() * (isodow({t}) - 1) / 7)",
             "case when isodow({t}) >= 6 then 1.0 else 0.0 end",
             "sin(2 * pi() * month({t}) / 12)", "cos(2 * pi() * month({t}) / 12)"]


def _arima(p: str, src: str, s: arima.Settings, regressors: bool) -> str:
    """``{p}z``: the chosen model of every series, with what forecasts need."""
    lags, m, const, y = s.long_lags, s.period, arima.CONST, arima.N_COLUMNS + 1
    first, keep = lags + m, m + max(arima.X_LAGS)
    diff = lambda x, j: f"list_transform(range(1, len({x}) - {j} + 1), lambda q: {x}[q + {j}] - {x}[q])"
    if regressors:
        cols = ["list_transform(t, lambda q: cast(1 as double))"] + \
            [f"list_transform(t, lambda q: cast({c.format(t='q')} as double))" for c in _CALENDAR]
        head = f"""
{p}q as (select *, [{', '.join(cols)}] as cc from {src}),
{p}qa as (select client_id as k, len(cc) as n, i, list_append(list_transform(cc, lambda b: list_inner_product(cc[i], b)),
                 list_inner_product(cc[i], y)) as row from (select *, unnest(range(1, len(cc) + 1)) as i from {p}q)),
{_solve(p + 'qb', p + 'qa')},
{p}y as (select q.client_id, q.last_ts, q.n, b.beta, list_transform(range(1, q.n + 1), lambda j: q.y[j] -
                 list_inner_product(b.beta, list_transform(q.cc, lambda c: c[j]))) as r
         from {p}q q join {p}qb b on b.k = q.client_id),"""
    else:
        head = f"{p}y as (select client_id, last_ts, n, cast(null as double[]) as beta, y as r from {src}),"
    if s.differences is None:
        pick = "qualify row_number() over (partition by client_id order by round(list_var_pop(x), 9), 2 * sd + d) = 1"
    else:
        pick = f"where d = {s.differences[0]} and sd = {s.differences[1]}"
    orders = arima.orders(s)
    listed = ", ".join(f"({i}, [{', '.join(str(c + 1) for c in arima.columns_of(o))}]::integer[])" for i, o in enumerate(orders))
    back = lambda c, j: f"{c}[{first - j + 1}:{first - j} + len(x) - {first}]"
    columns = [*[back("x", j) for j in arima.X_LAGS], back("x", m), *[back("e", j) for j in arima.E_LAGS], back("e", m),
               f"list_transform(range(0, len(x) - {first}), lambda q: cast(1 as double))", back("x", 0)]
    return f"""
{head}
{p}w as (select * from (
  select client_id, 0 as d, 0 as sd, r as x from {p}y
  union all select client_id, 1, 0, {diff('r', 1)} from {p}y
  union all select client_id, 0, 1, {diff('r', m)} from {p}y
  union all select client_id, 1, 1, {diff('rd', 1)} from (select client_id, {diff('r', m)} as rd from {p}y))
  {pick}),
{p}c as (select *, list_transform(range(0, {lags + 1}), lambda j: list_inner_product(z[j + 1:], z[1:len(z) - j]) / len(z)) as cov
         from (select *, list_transform(x, lambda q: q - list_avg(x)) as z from {p}w)),
{p}ya as (select client_id as k, {lags} as n, i, list_append(list_transform(range(1, {lags + 1}), lambda j: cov[abs(i - j) + 1]), cov[i + 1]) as row
          from (select *, unnest(range(1, {lags + 1})) as i from {p}c)),
{_solve(p + 'yb', p + 'ya')},
{p}v as (select client_id, d, sd, x, [{', '.join(columns)}] as v, len(x) - {first} as nr
         from (select c.*, list_transform(range(1, len(z) + 1), lambda t: case when t <= {lags} then 0.0 else
                 z[t] - list_inner_product(b.beta, list_reverse(z[t - {lags}:t - 1])) end) as e
               from {p}c c join {p}yb b on b.k = c.client_id)),
{p}m as (select *, list_transform(v, lambda a: list_transform(v, lambda b: list_inner_product(a, b))) as m from {p}v),
{p}o as (select client_id, o, case when d + sd < 2 then list_append(cols, {const + 1}) else cols end as cols, m, nr
         from {p}m, (values {listed}) t(o, cols)),
{p}oa as (select client_id || '/' || o as k, len(cols) as n, i,
                 list_append(list_transform(range(1, len(cols) + 1), lambda j: m[cols[i]][cols[j]]
                             + case when i = j then 1e-10 * m[cols[i]][cols[i]] else 0.0 end), m[cols[i]][{y}]) as row
          from (select *, unnest(range(1, len(cols) + 1)) as i from {p}o)),
{_solve(p + 'ob', p + 'oa')},
{p}k as (select client_id, o, cols, w from (
  select *, row_number() over (partition by client_id order by round(nr * ln(greatest(yy - ex, 1e-12 * yy, 1e-12) / nr)
              + 2.0 * (len(cols) + 1) + 2.0 * (len(cols) + 1) * (len(cols) + 2) / greatest(nr - len(cols) - 2, 1), 9), o) as place
  from (select a.client_id, a.o, a.cols, a.nr, a.m[{y}][{y}] as yy, coalesce(b.beta, cast([] as double[])) as w,
               coalesce(list_sum(list_transform(range(1, len(a.cols) + 1), lambda j: b.beta[j] * a.m[a.cols[j]][{y}])), 0.0) as ex
        from {p}o a left join {p}ob b on b.k = a.client_id || '/' || a.o)) where place = 1),
{p}l as (select *, list_transform(range(1, {arima.N_COLUMNS + 1}), lambda c: coalesce(w[list_position(cols, c)], 0.0)) as weight from {p}k),
{p}z as (select y.client_id, y.last_ts, y.beta, v.d, v.sd, l.weight, v.x[len(v.x) - {keep - 1}:] as xt, y.r[len(y.r) - {keep - 1}:] as rt,
                case when v.sd = 1 then list_transform(range(len(y.r) - {keep - 1}, len(y.r) + 1), lambda q: y.r[q] - y.r[q - {m}])
                     else y.r[len(y.r) - {keep - 1}:] end as ut,
                list_transform(range(v.nr - {keep - 1}, v.nr + 1), lambda t: v.v[{y}][t]
                               - list_inner_product(l.weight, list_transform(v.v[1:{arima.N_COLUMNS}], lambda c: c[t]))) as et
         from {p}y y join {p}v v using (client_id) join {p}l l using (client_id))"""


def _arima_path(p: str, model: str, hours: str, s: arima.Settings, regressors: bool) -> str:
    m, keep = s.period, s.period + max(arima.X_LAGS)
    x = f"weight[{arima.CONST + 1}]" + "".join(f" + weight[{k}] * x[{keep + 1 - j}]" for k, j in enumerate((*arima.X_LAGS, m), 1)) + "".join(
        f" + weight[{k}] * case when step < {j} then et[{keep - j + 1} + step] else 0.0 end"
        for k, j in enumerate((*arima.E_LAGS, m), len(arima.X_LAGS) + 2))
    design = "[1.0, " + ", ".join(f"cast({c.format(t='ts')} as double)" for c in _CALENDAR) + "]"
    more = f" + list_inner_product(beta, {design})" if regressors else ""
    return f"""
{p}pr(client_id, step, x, u, r) as (
  select client_id, 0, xt, ut, rt from {p}z
  union all
  select client_id, step + 1, list_append(x[2:], vx), list_append(u[2:], vx + d * u[{keep}]),
         list_append(r[2:], vx + d * u[{keep}] + sd * r[{keep - m + 1}])
  from (select q.*, z.d, z.sd, {x} as vx from {p}pr q join {p}z z using (client_id) where step < (select h from {hours}))),
{p}p as (select model, client_id, ts, yhat{more} as yhat from (
  select '{model}' as model, client_id, last_ts + to_hours(step) as ts, r[{keep}] as yhat, beta
  from {p}pr join {p}z using (client_id) where step > 0))"""


# --------------------------------------------------------------- pooled model

_SCALE = "case when {ss} / {n} - ({s} / {n}) * ({s} / {n}) > 1e-12 * {ss} / {n} " \
         "then sqrt({ss} / {n} - ({s} / {n}) * ({s} / {n})) else 1.0 end"


def _pooled(p: str, hist: str, size: int, chunk: int) -> str:
    """``{p}x``: features and scaled value of every row with a value (NULL without
    a window); ``{p}u``: moment sums; ``{p}b``: weights."""
    slot, n = "(isodow(ts) - 1) * 24 + hour(ts)", 11
    cal = ", ".join(f"cast({c.format(t='ts')} as double)" for c in _CALENDAR)
    z = lambda c: f"coalesce(({c} - mu) / sd, 0.0)"
    return f"""
{p}e as (select client_id, max(ts) as last_ts from {hist} group by 1),
{p}g as (select h.*, date_diff('hour', ts, last_ts) as g, {slot} as slot from {hist} h join {p}e using (client_id) where y is not null),
{p}i as (select *, unnest(range(greatest(1, cast(ceil((g - {size} + 1) / {chunk}) as bigint)), g // {chunk} + 1)) as k from {p}g),
{p}s as (select client_id, k, n, s / n as mu, {_SCALE.format(n='n', s='s', ss='ss')} as sd, level from (
  select client_id, k, count(*) as n, sum(y) as s, sum(y * y) as ss, avg(y) filter (where g - k * {chunk} < 24) as level from {p}i group by 1, 2)),
{p}h as (select client_id, k, slot, avg(y) as how from {p}i group by 1, 2, 3),
{p}o as (select client_id, k, slot % 24 as hod_slot, avg(y) as hod from {p}i group by 1, 2, 3),
{p}x as (select case when n > 0 then [{z('how')}, {z('hod')}, {z('level')}, {cal}, 1.0, (y - mu) / sd] end as x
         from (select client_id, ts, y, slot, slot % 24 as hod_slot, g // {chunk} + 1 as k from {p}g)
         left join {p}s using (client_id, k) left join {p}h using (client_id, k, slot) left join {p}o using (client_id, k, hod_slot)),
{p}u as (select i, j, sum(x[i] * x[j]) as v from {p}x, range(1, {n + 1}) a(i), range(1, {n + 2}) b(j) where j >= i group by 1, 2),
{p}f as (select i, j, coalesce(v, 0) + case when i = j then 1e-3 else 0 end as v from {p}u
         union all select j, i, v from {p}u where i < j and j <= {n}),
{p}a as (select 0 as k, {n} as n, i, list(v order by j) as row from {p}f group by i),
{_solve(p + 'b', p + 'a')}"""


def _rolling(p: str, hist: str, weights: str, rounds: str, size: int, chunk: int) -> str:
    """``{p}p``: forecasts of ``rounds`` chunks after each series' history."""
    mod = lambda x, m: f"((({x}) % {m} + {m}) % {m})"
    at = lambda s, m: (f"list_avg(list_transform(range({mod(f'{s} - base + {size - 1}', m)}, {size}, {m}), lambda j: w[j + 1]))")
    cal = [c.format(t="(till + to_hours(cast(i as integer)))") for c in _CALENDAR]
    z = lambda c: f"coalesce(({c} - mu) / sd, 0.0)"
    terms = [z(f"how[{mod('base + i', 168)} + 1]"), z(f"hod[{mod('base + i', 24)} + 1]"), z("level"), *cal, "1.0"]
    value = " + ".join(f"beta[{k}] * {t}" for k, t in enumerate(terms, 1))
    return f"""
{p}e as (select client_id, max(ts) as last_ts from {hist} group by 1),
{p}w as (select client_id, any_value(last_ts) as till, list(y order by place) as w from (
  select e.client_id, e.last_ts, place, h.y from {p}e e cross join range(0, {size}) t(place)
  left join {hist} h on h.client_id = e.client_id and h.ts = e.last_ts - to_hours(cast({size - 1} - place as integer))) group by 1),
{p}r(client_id, till, step, w, made) as (
  select client_id, till, 0, w, cast([] as double[]) from {p}w
  union all
  select client_id, till + to_hours({chunk}), step + 1,
         list_concat(w, list_transform(made, lambda v: cast(cast(v as float) as double)))[{chunk + 1}:{chunk + size}], made
  from (select client_id, till, step, w, list_transform(range(1, {chunk + 1}), lambda i: mu + sd * ({value})) as made
        from (select *, list_transform(range(0, 168), lambda s: {at('s', 168)}) as how,
                     list_transform(range(0, 24), lambda s: {at('s', 24)}) as hod,
                     list_avg(w[{max(1, size - 23)}:]) as level, su / cn as mu, {_SCALE.format(n='cn', s='su', ss='sq')} as sd
              from (select *, (isodow(till) - 1) * 24 + hour(till) as base, list_count(w) as cn, list_sum(w) as su,
                           list_sum(list_transform(w, lambda v: v * v)) as sq
                    from {p}r, (select beta from {weights}) where step < {rounds})))),
{p}p as (select client_id, till - to_hours(cast({chunk} - i as integer)) as ts, made[i] as yhat
         from (select *, unnest(range(1, {chunk + 1})) as i from {p}r where step > 0) where made[i] is not null)"""


def _predictions(source: str) -> str:
    return f"select model, client_id, ts, {_r('yhat')} as yhat from {source}"


def oracle_sql() -> dict[str, str]:
    from .forecast_jobs import FIXED
    auto = arima.Settings()
    seasons = tuple((p, k) for p, k in additive.SEASONS if 2 * p <= 480)       # train: 20 days
    train = _part("train", ("train",))
    both = _part("hist", ("train", "validation"))
    start = f"with recursive {_panel()}, {train}"
    val = _hours("hv", "validation", "train", "count")
    q = {}
    q["f01_ets"] = f"{start}, {val},{_series('e', 'train')},{_ets('e', 'es', 'hv')}\n{_predictions('ep')}"
    for name, model, regressors in (("f02_arima", "arima", False), ("f03_arimax", "arimax", True), ("s14_model_table", "arima", False)):
        q[name] = f"""{start}, {val},{_series('m', 'train')},{_arima('m', 'ms', auto, regressors)},
{_arima_path('m', model, 'hv', auto, regressors)}
{_predictions('mp')}"""
    q["f03_coefficients"] = f"""{start},{_series('m', 'train')},{_arima('m', 'ms', FIXED, True)}
select client_id, part, cast(i - 1 as integer) as "column", {_r('v[i]', 6)} as value from (
  select client_id, part, v, unnest(range(1, len(v) + 1)) as i from (
    select client_id, 'beta' as part, beta as v from mz union all select client_id, 'weight', weight from mz))"""
    fit = f"{start},{_additive('l', 'train', seasons)}"
    q["f04_coefficients"] = f"""{fit}
select k as client_id, cast(i - 1 as integer) as "column", {_r('beta[i]', 6)} as value
from (select k, beta, unnest(range(1, len(beta) + 1)) as i from lx)"""
    columns = _additive_columns("ts", "(epoch(ts) / 3600.0)", seasons)
    q["f04_additive"] = f"""{fit}, {val},
lp as (select 'additive' as model, client_id, ts, list_inner_product(beta, {columns}) as yhat
       from (select client_id, h0, sp, beta, last_ts + to_hours(cast(step as integer)) as ts
             from lb join lx on lx.k = lb.client_id, (select unnest(range(1, (select h from hv) + 1)) as step)))
{_predictions('lp')}"""
    q["j05_fitted_series"] = f"""{start}
select 'ets' as model, case when cast(client_id as bigint) % 10 = 0 then 'no values' else 'ok' end as status, count(distinct client_id) as series
from train group by 1, 2"""
    phases = f"""{start}, {both}, {_hours('hv', 'validation', 'train', 'span')}, {_hours('ht', 'test', 'hist', 'span')},
{_series('e', 'train')},{_ets('e', 'es', 'hv')},{_series('g', 'hist')},{_ets('g', 'gs', 'ht')}"""
    pair = lambda preds, split: f"select p.client_id, a.y, p.yhat from {preds} p join pan a on a.client_id = p.client_id and a.ts = p.ts and a.split = '{split}'"  # noqa: E731, E501
    from .forecast_jobs import GLOBAL_CHUNK, GLOBAL_INPUT, REFERENCE_CHUNK, REFERENCE_INPUT
    years = f"with recursive hist as (select client_id, ts, cast(y as double) as y from ({_hourly(L_RAW)}))"
    q["f10_moments"] = f"""{years},{_pooled('m', 'hist', REFERENCE_INPUT, REFERENCE_CHUNK)}
select cast(row_number() over (order by j = 12, i, j) - 1 as integer) as number, {_r('v')} as value from mu
union all select -1, cast(count(x) as double) from mx
union all select -2, cast(count(*) filter (where x is null) as double) from mx"""
    ahead = lambda size, chunk: f"""{_pooled('m', 'hist', size, chunk)},{_rolling('r', 'hist', 'mb', '1', size, chunk)}
select 'global_linear' as model, client_id, ts, {_r('yhat')} as yhat from rp"""  # noqa: E731
    q["f10_reference_sizes"] = f"{years},{ahead(REFERENCE_INPUT, REFERENCE_CHUNK)}"
    whole = f"{start}, {both}"
    q["f10_global"] = f"{whole},{ahead(GLOBAL_INPUT, GLOBAL_CHUNK)}"
    scores = lambda actual: _metrics_sql(
        f"select p.client_id, a.y, p.yhat from rp p join {actual} a on a.client_id = p.client_id and a.ts = p.ts", "", True, 4)
    q["f09_rolling"] = f"""{whole},{_pooled('m', 'hist', GLOBAL_INPUT, GLOBAL_CHUNK)},
actual as (select client_id, ts, y from pan where split = 'test'),
ahead as (select cast(ceil(date_diff('hour', (select max(ts) from hist), max(ts)) / {GLOBAL_CHUNK}) as bigint) as n from actual),
{_rolling('r', 'hist', 'mb', '(select n from ahead)', GLOBAL_INPUT, GLOBAL_CHUNK)}
{scores('actual')}"""
    q["f11_global_proxy"] = f"""{whole},{_pooled('m', 'hist', GLOBAL_INPUT, GLOBAL_CHUNK)}, {val},
cut as (select min(ts) as ts from (select ts, row_number() over (partition by client_id order by ts desc) as rn from train)
        where rn = (select h from hv)),
before as (select * from train where ts < (select ts from cut)), actual as (select * from train where ts >= (select ts from cut)),
ahead as (select cast(ceil(date_diff('hour', (select max(ts) from before), max(ts)) / {GLOBAL_CHUNK}) as bigint) as n from actual),
{_rolling('r', 'before', 'mb', '(select n from ahead)', GLOBAL_INPUT, GLOBAL_CHUNK)}
{scores('actual')}"""
    q["f05_aggregate_arima"] = f"""with recursive {_prep_ctes(E_RAW)},
tot as (select ts, sum(cast(y as double)) as s from hourly group by ts),
pan as (select 'aggregate' as client_id, *, {_splits_sql()} as split
        from (select s.ts, cast(cast(coalesce(t.s, 0.0) as float) as double) as y from spine s left join tot t on t.ts = s.ts)),
{train}, {_hours('hv', 'validation', 'train', 'span')},{_series('m', 'train')},{_arima('m', 'ms', auto, False)},
{_arima_path('m', 'arima', 'hv', auto, False)}
{_predictions('mp')}"""
    q["f06_in_sample"] = f"""{start},{_series('m', 'train')},{_arima('m', 'ms', auto, False)},
mf as (select client_id, y, y - e as yhat from (
  select v.client_id, s.y[s.n - v.nr + q] as y, v.v[{arima.N_COLUMNS + 1}][q]
         - list_inner_product(l.weight, list_transform(v.v[1:{arima.N_COLUMNS}], lambda c: c[q])) as e
  from (select *, unnest(range(1, nr + 1)) as q from mv) v join ml l using (client_id) join ms s using (client_id)))
{_metrics_sql('select * from mf', '', False, 4)}"""
    q["f12_by_name"] = f"""{start}, {_hours('hv', 'validation', 'train', 'span')},{_series('e', 'train')},{_ets('e', 'es', 'hv')},
{_arima('m', 'es', auto, False)},
{_arima_path('m', 'arima', 'hv', auto, False)},
pr as (select p.model, p.client_id, a.y, p.yhat from (select * from ep union all select * from mp) p
       join pan a on a.client_id = p.client_id and a.ts = p.ts and a.split = 'validation'),
met as ({_metrics_sql('select * from pr', 'model', True, None)})
select model, {_r('MSE')} as MSE, {_r('MAE')} as MAE, {_r('WAPE')} as WAPE,
       cast(rank() over (order by WAPE nulls last, MSE nulls last, model) as integer) as rank
from met where client_id = 'OVERALL'"""
    q["f08_backtest"] = f"""{phases}
select *, 'validation' as phase from ({_metrics_sql(pair('ep', 'validation'), '', False, 4)})
union all select *, 'test' from ({_metrics_sql(pair('gp', 'test'), '', False, 4)})"""
    return q
