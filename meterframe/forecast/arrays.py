"""Small dense algebra on array columns, one system or series per row.

Everything here is a Spark expression (higher-order functions on arrays), so a
row's systems are solved inside the JVM, without a Python worker, and Spark
distributes the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..schema import CLIENT, TS, Y

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.  What a lambda uses must be
    bound like this: the optimizer may put the expression of a column in the
    place where it is used, and a lambda would evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def let_all(names: list[str], body: Callable[..., Column]) -> Column:
    """``body`` of several columns, each evaluated once."""
    if not names:
        return body()
    return let(F.col(names[0]), lambda v: let_all(names[1:], lambda *rest: body(v, *rest)))


def moved(state: Column, value: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The next ``state`` of a fold, ``step(state, value)``, with ``value`` evaluated once.
    Unlike :func:`let`, whose result is copied to its last element, the state is handed on as it is."""
    return F.aggregate(F.array(value), state, step)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def variance(x: Column) -> Column:
    return let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x))


def skip(x: Column, n: int | Column) -> Column:
    """``x`` without its first ``n`` values (empty if it has no more)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))


def difference(x: Column, lag: int) -> Column:
    return F.zip_with(skip(x, lag), F.slice(x, 1, F.greatest(F.size(x) - lag, F.lit(0))), lambda a, b: a - b)


def solve(rows: Column, eps: float = 1e-9) -> Column:
    """Solution of the linear system whose augmented rows (coefficients, then
    right side) are ``rows``: elimination, one pivot after another.

    The matrix is one of sums of products (symmetric, not negative), so pivots
    are taken in order.  A column that depends on earlier ones (its pivot is
    below ``eps`` of what it was) gets 0."""
    def solved(whole: Column) -> Column:
        def at_pivot(m: Column, p: Column) -> Column:
            rest = lambda row: F.slice(row, F.lit(2), F.size(row))
            # what all values of a row need is bound, not looked up for each
            lead = let(m[p], lambda row: let(row[0], lambda head: F.when(
                F.abs(head) > eps * F.abs(whole[p][p]), F.transform(rest(row), lambda v: v / head))
                .otherwise(F.transform(rest(row), lambda v: F.lit(0.0)))))
            return let(lead, lambda r: F.transform(m, lambda row, i: F.when(i == p, r).otherwise(
                let(row[0], lambda head: F.zip_with(rest(row), r, lambda a, b: a - head * b)))))

        pivots = F.sequence(F.lit(0), F.size(whole) - 1)
        return F.aggregate(pivots, whole, at_pivot, lambda m: F.transform(m, lambda row: row[0]))

    return let(rows, lambda whole: F.when(F.size(whole) > 0, solved(whole)).otherwise(F.array().cast("array<double>")))


def products(columns: Column) -> Column:
    """The matrix of the products of ``columns`` (an array of arrays); it is
    symmetric, so each product is summed once."""
    upper = F.transform(columns, lambda a, i: F.transform(skip(columns, i), lambda b: dot(a, b)))
    return let(upper, lambda u: F.transform(u, lambda row, i: F.concat(
        F.transform(F.slice(u, F.lit(1), i), lambda above, j: above[i - j]), row)))


def remainder(y: Column, parts: Column) -> Column:
    """``y`` less each of ``parts``, structs of a weight w and an array x: one
    part after the other is taken off the whole array."""
    return F.aggregate(parts, y, lambda left, part: F.zip_with(left, part["x"], lambda a, b: a - part["w"] * b))


def leave_out(m: Column) -> Column:
    """The symmetric matrix ``m`` without its first row and column."""
    return F.transform(skip(m, 1), lambda row: skip(row, 1))


def eliminate(m: Column, whole: Column, eps: float = 1e-9) -> Column:
    """What the first column of the symmetric matrix ``m`` leaves of the others.
    If it depends on columns eliminated before (its pivot is below ``eps`` of
    ``whole``, what it was), it takes nothing off."""
    return let(m[0], lambda first: let(skip(first, 1), lambda r: F.transform(skip(m, 1), lambda row: let(
        F.when(first[0] > eps * whole, row[0] / first[0]).otherwise(F.lit(0.0)),
        lambda f: F.zip_with(skip(row, 1), r, lambda a, b: a - f * b)))))


def autoregression(cov: Column, lags: int, eps: float = 1e-9) -> Column:
    """Weights of the autoregression on ``lags`` earlier values with the
    autocovariances ``cov`` (0 to ``lags``): Levinson and Durbin's recursion,
    the solution of their system in steps by the square of ``lags``.

    ``left`` is the pivot of :func:`solve`: lags that depend on earlier ones,
    and all after them, get 0."""
    def step(c: Column, acc: Column, k: Column) -> Column:
        new = (c[k + 1] - dot(acc["a"], F.reverse(F.slice(c, F.lit(2), k)))) / acc["left"]
        more = let(new, lambda r: F.struct(
            F.concat(F.zip_with(acc["a"], F.reverse(acc["a"]), lambda x, y: x - r * y), F.array(r)).alias("a"),
            (acc["left"] * (1 - r * r)).alias("left")))
        return F.when(acc["left"] > eps * c[0], more).otherwise(F.struct(
            F.concat(acc["a"], F.array(F.lit(0.0))).alias("a"), acc["left"].alias("left")))

    return let(cov, lambda c: F.aggregate(
        F.sequence(F.lit(0), F.lit(lags - 1)), F.struct(F.array().cast("array<double>").alias("a"), c[0].alias("left")),
        lambda acc, k: step(c, acc, k), lambda acc: acc["a"]))


def triangle(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def moments(columns: list[Column], y: Column) -> list[Column]:
    """Aggregates: sums of products of the columns (upper triangle, row by
    row), then of each column with ``y``; rows without ``y`` do not count."""
    has = y.isNotNull()
    return [F.sum(F.when(has, columns[i] * columns[j])) for i, j in triangle(len(columns))] + \
        [F.sum(c * y) for c in columns]


def system(sums: Column, n: int, ridge: list[float] | None = None) -> Column:
    """Augmented rows from the array of :func:`moments` of ``n`` columns."""
    at = {}
    for k, (i, j) in enumerate(triangle(n)):
        at[i, j] = at[j, i] = k
    m = len(triangle(n))
    return F.array(*[F.array(*[sums[at[i, j]] + (ridge[i] if ridge and i == j else 0.0) for j in range(n)], sums[m + i])
                     for i in range(n)])


def filled(x: Column) -> Column:
    """``x`` with missing values filled linearly between their neighbours and flat
    at the ends; all 0 if there is no value.  Between two known values that
    follow each other there is one stretch, so the work is that of the length."""
    known = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("k"), v.alias("v"))), lambda e: e["v"].isNotNull())

    def between(a: Column, b: Column) -> Column:
        return F.transform(F.sequence(a["k"], b["k"] - 1),
                           lambda k: a["v"] + (b["v"] - a["v"]) * (k - a["k"]) / (b["k"] - a["k"]))

    def whole(known: Column) -> Column:
        n = F.size(known)
        first, last = known[0], known[n - 1]
        return F.concat(F.array_repeat(first["v"], first["k"]),
                        F.flatten(F.zip_with(F.slice(known, F.lit(1), n - 1), F.slice(known, F.lit(2), n - 1), between)),
                        F.array_repeat(last["v"], F.size(x) - last["k"]))

    return let(known, lambda known: F.when(F.size(known) > 0, whole(known)).otherwise(F.array_repeat(F.lit(0.0), F.size(x))))


def series(history: DataFrame) -> DataFrame:
    """One row per series: (client_id, last_ts, n_values, ts, y), the last two
    being arrays in order of time.

    Missing values are filled (:func:`filled`); a series without any value has ``n_values``
    0 and is all 0.  A row holds the rows of one series, which are bounded by
    the lookback or the time range."""
    got = history.where(F.col(CLIENT).isNotNull() & F.col(TS).isNotNull()) \
        .select(CLIENT, TS, nan_to_null(F.col(Y).cast("double")).alias("v")) \
        .groupBy(CLIENT).agg(F.max(TS).alias("last_ts"), F.count("v").alias("n_values"),
                             F.sort_array(F.collect_list(F.struct(TS, "v"))).alias("rows"))
    values = F.col("rows")["v"]
    return got.select(CLIENT, "last_ts", "n_values", F.col("rows")[TS].alias(TS),
                      F.when(F.col("n_values") == F.size("rows"), values).otherwise(filled(values)).alias(Y))
