"""Seasonal ARIMA (F2, F5) and regression with ARIMA errors.

Differences: of the four combinations of a seasonal (lag 24) and a regular
difference the one whose result varies least.

Orders (Hannan and Rissanen 1982): a long autoregression, from the
autocovariances, gives estimates of the innovations.  All candidate models are
regressions of a value on some of the same columns: lags 1 to 3 and 24 of the
series, lags 1, 2 and 24 of the innovations, and a constant.  So one matrix of
the products of these columns per series serves all of them: the candidates
share the elimination of the columns they have in common, AICc picks one, and
only its system is solved.

With regressors (F3) the series is first regressed on the calendar columns,
and the model describes what is left; future values of the regressors follow
from the hour forecast, never from its position.

All of it is array expressions on one row per series.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import CALENDAR_COLS, calendar_columns
from ..schema import CLIENT, TS, Y
from .arrays import (
    autoregression, difference, dot, eliminate, leave_out, let, let_all, mean, moved, products, remainder, series, skip, solve, variance,
)


@dataclass(frozen=True)
class Settings:
    period: int = 24
    long_lags: int = 28                  # of the autoregression for the innovations
    least_rows: int = 20                 # rows of the regressions; below it only the mean is modelled
    order: tuple | None = None           # (p, q, P, Q) instead of the choice by AICc
    differences: tuple | None = None     # (d, D) instead of the choice by variance


#: Columns of the regressions: lags of the series, lags of the innovations, constant.
X_LAGS, E_LAGS = (1, 2, 3), (1, 2)
CONST = len(X_LAGS) + 1 + len(E_LAGS) + 1
N_COLUMNS = CONST + 1


def orders(s: Settings) -> list[tuple[int, int, int, int]]:
    return [s.order] if s.order else list(product(range(4), range(3), (0, 1), (0, 1)))


def columns_of(order: tuple[int, int, int, int]) -> list[int]:
    """Numbers of the columns of a model without constant."""
    p, q, big_p, big_q = order
    seasonal_x, first_e = len(X_LAGS), len(X_LAGS) + 1
    return [*range(p), *([seasonal_x] if big_p else []), *range(first_e, first_e + q),
            *([first_e + len(E_LAGS)] if big_q else [])]


def _differenced(df: DataFrame, s: Settings) -> DataFrame:
    """Columns d, seasonal_d (differences taken) and x (the result)."""
    y, period = F.col("r"), s.period
    df = df.withColumn("r_D", F.when(F.size("r") > 3 * period, difference(y, period)))
    df = df.withColumn("ways", F.array(
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("seasonal_d"), F.col("r").alias("x")),
        F.struct(F.lit(1).alias("d"), F.lit(0).alias("seasonal_d"), difference(y, 1).alias("x")),
        F.struct(F.lit(0).alias("d"), F.lit(1).alias("seasonal_d"), F.col("r_D").alias("x")),
        F.struct(F.lit(1).alias("d"), F.lit(1).alias("seasonal_d"), difference(F.col("r_D"), 1).alias("x"))))
    if s.differences is not None:
        d, big_d = s.differences
        chosen = F.filter("ways", lambda w: (w["d"] == d) & (w["seasonal_d"] == big_d) & w["x"].isNotNull() & (F.size(w["x"]) > 0))
        df = df.withColumn("way", F.coalesce(F.get(chosen, F.lit(0)), F.col("ways")[0]))
    else:
        # variances to 9 digits, fewer differences on ties
        spread = F.transform("ways", lambda w, i: F.struct(
            (w["x"].isNull() | (F.size(w["x"]) == 0)).alias("not"),
            F.round(F.when(F.size(w["x"]) > 0, variance(w["x"])), 9).alias("v"), i.alias("i")))
        df = df.withColumn("way", F.col("ways")[F.array_min(spread)["i"]])
    return df.withColumn("d", F.col("way.d")).withColumn("seasonal_d", F.col("way.seasonal_d")).withColumn("x", F.col("way.x")) \
        .drop("ways", "way", "r_D")


def _innovations(df: DataFrame, s: Settings) -> DataFrame:
    """Column e: what the long autoregression leaves of x, 0 for its first rows."""
    lags = s.long_lags
    n = F.size("x")
    df = df.withColumn("mu", mean(F.col("x"))) \
        .withColumn("z", let_all(["mu"], lambda mu: F.transform("x", lambda v: v - mu)))
    df = df.withColumn("cov", let_all(["z"], lambda z: F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda j: dot(
        skip(z, j), F.slice(z, F.lit(1), F.greatest(F.size(z) - j, F.lit(0)))) / F.size(z))))
    df = df.withColumn("ar", F.when(n > lags, autoregression(F.col("cov"), lags)))
    none = F.array_repeat(F.lit(0.0), F.least(F.size("z"), F.lit(lags)))
    return df.withColumn("e", F.when(F.col("ar").isNull(), none).otherwise(F.concat(none, let_all(
        ["ar", "z"], lambda ar, z: F.aggregate(F.sequence(F.lit(0), F.lit(lags - 1)), skip(z, lags), lambda left, j: moved(
            left, ar[j], lambda left, w: F.zip_with(left, F.slice(z, lags - j, F.size(z) - lags), lambda a, b: a - w * b)))))))


def _regressions(df: DataFrame, s: Settings) -> DataFrame:
    """Columns first (first row of the regressions), v (arrays of the columns
    and the target) and m (their products)."""
    first = s.long_lags + s.period
    n_rows = F.greatest(F.size("x") - first, F.lit(0))
    lag = lambda c, j: F.slice(c, F.lit(first - j + 1), n_rows)
    one = F.array_repeat(F.lit(1.0), n_rows)
    cols = [*[lag("x", j) for j in X_LAGS], lag("x", s.period), *[lag("e", j) for j in E_LAGS], lag("e", s.period), one,
            lag("x", 0)]
    return df.withColumn("n_rows", n_rows).withColumn("v", F.array(*cols)).withColumn("m", let_all(["v"], products))


#: Order in which columns are eliminated, those that all candidates share first, and the target.
ELIMINATED = (CONST, len(X_LAGS), CONST - 1, len(X_LAGS) + 1, len(X_LAGS) + 2, 0, 1, 2, N_COLUMNS)


def _sums_left(m: Column, with_const: Column) -> Column:
    """Sums of squares that the candidates leave, in the order of :func:`orders`.

    Candidates share eliminations: the matrix of the products is taken down
    column by column, and at each column branches into without and with it
    (for the regular lags: none, the first, the first two, ..).  What is left
    at the place of the target is the sum of squares of the columns taken."""
    ridge = lambda c: m[c][c] * (1 + 1e-10)
    take = lambda x, c: eliminate(x, ridge(c))
    const, big_p, big_q, e_1, e_2, *x_lags, y = ELIMINATED
    whole = F.array(*[F.array(*[ridge(i) if i == j != y else m[i][j] for j in ELIMINATED]) for i in ELIMINATED])
    states = F.array(let(whole, lambda x: F.when(with_const, take(x, const)).otherwise(leave_out(x))))
    for c in (big_p, big_q):
        states = F.flatten(F.transform(states, lambda x: F.array(leave_out(x), take(x, c))))  # noqa: B023
    states = F.flatten(F.transform(states, lambda x: let(take(x, e_1), lambda one: F.array(
        leave_out(leave_out(x)), leave_out(one), take(one, e_2)))))
    left = F.flatten(F.transform(states, lambda x: let(take(x, x_lags[0]), lambda a: let(take(a, x_lags[1]), lambda b: F.array(
        x[3][3], a[2][2], b[1][1], take(b, x_lags[2])[0][0])))))
    at = [((big_p * 2 + big_q) * 3 + q) * 4 + p for p, q, big_p, big_q in orders(Settings())]
    return let(left, lambda x: F.array(*[x[i] for i in at]))


def _aicc(left: Column, whole: Column, n: Column, k: Column) -> Column:
    """AICc of ``k`` parameters that leave the sum of squares ``left`` of ``whole``."""
    sse = F.greatest(left, 1e-12 * whole, F.lit(1e-12))
    return F.round(n * F.ln(sse / F.greatest(n, F.lit(1))) + 2.0 * k + 2.0 * k * (k + 1) / F.greatest(n - k - 1, F.lit(1)), 9)


def _choose(df: DataFrame, s: Settings) -> DataFrame:
    """Columns cols, w (weights), aicc and order of the chosen model: only its
    system is solved."""
    plain = [columns_of(o) for o in orders(s)]
    ints = lambda x: F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")
    with_const = F.col("d") + F.col("seasonal_d") < 2                  # at most one difference
    enough, n = F.col("n_rows") >= s.least_rows, F.col("n_rows")
    if len(plain) > 1:
        size = F.array(*[F.lit(len(c)) for c in plain])
        k = F.when(with_const, 2).otherwise(1)
        scores = let_all(["m", "n_rows"], lambda m, rows: let(k, lambda k: F.array_min(F.transform(
            F.arrays_zip(_sums_left(m, with_const).alias("left"), size.alias("k")), lambda c, i: F.struct(
                _aicc(c["left"], m[N_COLUMNS][N_COLUMNS], rows, c["k"] + k).alias("score"), i.alias("i"))))))
        df = df.withColumn("best", F.when(enough, scores["i"]).otherwise(F.lit(0)))
    else:
        df = df.withColumn("best", F.lit(0))
    listed = F.array(*[ints(c) for c in plain])
    chosen = F.when(enough, F.get(listed, F.col("best"))).otherwise(ints([]))
    df = df.withColumn("cols", F.concat(chosen, F.when(with_const, ints([CONST])).otherwise(ints([]))))

    def system(m: Column, cols: Column) -> Column:
        return F.transform(cols, lambda i, a: F.concat(
            F.transform(cols, lambda j, b: m[i][j] + F.when(a == b, 1e-10 * m[i][i]).otherwise(F.lit(0.0))),
            F.array(m[i][N_COLUMNS])))

    only_mean = F.when(with_const, F.array(F.coalesce(F.col("mu"), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
    df = df.withColumn("w", F.when(enough, let_all(["m", "cols"], lambda m, cols: solve(system(m, cols)))).otherwise(only_mean))
    score = let_all(["m", "cols", "w"], lambda m, cols, w: _aicc(
        m[N_COLUMNS][N_COLUMNS] - dot(w, F.transform(cols, lambda j: m[j][N_COLUMNS])), m[N_COLUMNS][N_COLUMNS], n, F.size(cols) + 1))
    return df.withColumn("aicc", F.when(enough, score)) \
        .withColumn("order", F.when(enough, F.array(*[ints(o) for o in orders(s)])[F.col("best")])
                    .otherwise(ints([0, 0, 0, 0])))


def _weight(column: int) -> Column:
    """Weight of a column, 0 if the model does not use it."""
    return F.coalesce(F.get("w", F.array_position("cols", F.lit(column)).cast("int") - 1), F.lit(0.0))


def _modelled(rows: DataFrame, s: Settings, regressors: bool) -> DataFrame:
    df = rows.withColumn("status", F.when(F.col("n_values") > 0, "ok").otherwise("no values"))
    if regressors:
        df = _regressed(df)
    else:
        df = df.withColumn("beta", F.lit(None).cast("array<double>")).withColumn("r", F.col(Y))
    df = _choose(_regressions(_innovations(_differenced(df, s), s), s), s)
    df = df.withColumn("weight", F.array(*[F.when(F.array_contains("cols", c), _weight(c)).otherwise(F.lit(0.0))
                                           for c in range(N_COLUMNS)]))
    # errors of the chosen model, in the rows of the regressions
    left = let_all(["v"], lambda v: remainder(v[N_COLUMNS], F.zip_with("cols", "w", lambda c, w: F.struct(
        w.alias("w"), v[c].alias("x")))))
    return df.withColumn("left", left)


def _design(ts: Column) -> Column:
    return F.array(F.lit(1.0), *[calendar_columns(ts)[c].cast("double") for c in CALENDAR_COLS])


def _regressed(df: DataFrame) -> DataFrame:
    """Columns beta (constant, then the calendar columns; 0 for those that
    depend on earlier ones) and r, what they leave of y."""
    df = df.withColumn("design", F.transform(TS, _design))
    steps = F.sequence(F.lit(0), F.lit(len(CALENDAR_COLS)))
    df = df.withColumn("by_column", let_all(["design"], lambda rows: F.transform(
        steps, lambda i: F.transform(rows, lambda row: row[i]))))
    system = let_all(["by_column", Y], lambda cols, y: let(products(cols), lambda m: F.transform(
        cols, lambda a, i: F.concat(m[i], F.array(dot(a, y))))))
    df = df.withColumn("beta", solve(system))
    return df.withColumn("r", let_all(["by_column"], lambda cols: remainder(F.col(Y), F.zip_with("beta", cols, lambda w, x: F.struct(
        w.alias("w"), x.alias("x")))))).drop("by_column", "design")


def fit(history: DataFrame, settings: Settings = Settings(), regressors: bool = False) -> DataFrame:
    """(client_id, last_ts, status, n, order, d, seasonal_d, aicc, weight, beta, x_tail, e_tail, r_tail, u_tail):
    one row per series.  ``order`` is (p, q, P, Q), ``weight`` the weights of
    all columns, the tails what forecasts start from.  A series without a
    value has status ``no values`` and nothing else."""
    s = settings
    df = _modelled(series(history), s, regressors)
    keep = s.period + max(X_LAGS)
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - keep + 1, F.lit(1)), F.lit(keep))
    pad = lambda c: F.concat(F.array_repeat(F.lit(0.0), F.greatest(keep - F.size(c), F.lit(0))), c)
    df = df.withColumn("u", F.when(F.col("seasonal_d") == 1, difference(F.col("r"), s.period)).otherwise(F.col("r"))) \
        .withColumn("e_left", F.when(F.col("n_rows") >= s.least_rows, F.col("left")).otherwise(F.array().cast("array<double>")))
    out = {"order": F.col("order"), "d": F.col("d"), "seasonal_d": F.col("seasonal_d"), "aicc": F.col("aicc"), "weight": F.col("weight"),
           "beta": F.col("beta"), "x_tail": pad(tail("x")), "e_tail": pad(tail("e_left")), "r_tail": pad(tail("r")),
           "u_tail": pad(tail("u"))}
    return df.select(CLIENT, "last_ts", "status", F.size(Y).alias("n"),
                     *[F.when(F.col("status") == "ok", c).alias(name) for name, c in out.items()])


def path(steps: Column, period: int = 24) -> Column:
    """Forecasts 1 .. ``steps`` hours after the last value, from the columns of
    :func:`fit`, without the regressors' part."""
    keep = period + max(X_LAGS)
    at = lambda c, j: F.get(c, F.size(c) - j)
    w = F.col("weight")

    def step(acc: Column, i: Column) -> Column:
        past_error = lambda j: F.when(i <= j, F.get("e_tail", F.lit(keep - j) + i - 1)).otherwise(F.lit(0.0))
        x = w[CONST] + sum((w[k] * at(acc["x"], j) for k, j in enumerate((*X_LAGS, period))), F.lit(0.0)) \
            + sum((w[len(X_LAGS) + 1 + k] * past_error(j) for k, j in enumerate((*E_LAGS, period))), F.lit(0.0))
        return moved(acc, x, more)

    def more(acc: Column, x: Column) -> Column:
        u = x + F.col("d") * acc["u"]
        r = u + F.col("seasonal_d") * at(acc["r"], period)
        return F.struct(F.concat(acc["x"], F.array(x)).alias("x"), u.alias("u"), F.concat(acc["r"], F.array(r)).alias("r"))

    start = F.struct(F.col("x_tail").alias("x"), at(F.col("u_tail"), 1).alias("u"), F.col("r_tail").alias("r"))
    run = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: skip(acc["r"], keep))   # columns stored by fit
    return F.when(steps > 0, run).otherwise(F.array().cast("array<double>"))


def explained(ts: Column) -> Column:
    """The regressors' part at ``ts`` (0 without regressors)."""
    return F.when(F.col("beta").isNull(), F.lit(0.0)).otherwise(dot(_design(ts), F.col("beta")))


def fitted(history: DataFrame, settings: Settings = Settings(), regressors: bool = False) -> DataFrame:
    """(client_id, ts, yhat): one-step fitted values (F6), missing for the
    first rows, which the regressions leave out."""
    df = _modelled(series(history), settings, regressors).where("status = 'ok'")
    out = F.zip_with(Y, F.concat(F.array_repeat(F.lit(None).cast("double"), F.size(Y) - F.size("left")), F.col("left")),
                     lambda a, b: a - b)
    return df.withColumn("out", out).select(CLIENT, F.explode(F.arrays_zip(TS, "out")).alias("q")) \
        .select(CLIENT, F.col(f"q.{TS}").alias(TS), F.col("q.out").alias("yhat"))
