"""Wide <-> long reshaping and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLIENT, EDGE_NAMES, TS, Y


def select_series_columns(df: DataFrame, prefix: str | None = None,
                          exclude: tuple = (TS,)) -> list[str]:
    """Series columns of a wide table, by name prefix or by exclusion."""
    if prefix is not None:
        return [c for c in df.columns if c.startswith(prefix)]
    return [c for c in df.columns if c not in exclude]


def wide_to_long(wide: DataFrame, value_cols: list[str] | None = None,
                 ts: str = TS) -> DataFrame:
    """One row per (series, timestamp); missing cells are kept as NULL."""
    cols = value_cols or select_series_columns(wide, exclude=(ts,))
    return (wide.unpivot([ts], cols, CLIENT, Y)
            .select(F.col(CLIENT), F.col(ts).alias(TS), F.col(Y).cast("float").alias(Y)))


def long_to_wide(long: DataFrame, clients: list[str], value: str = Y,
                 ts: str = TS) -> DataFrame:
    """R2: one column per series, in the given (sorted) order.

    The name list is explicit, so Spark does not run a distinct job to find
    it; a series without a value at some time gets NULL."""
    return (long.groupBy(ts).pivot(CLIENT, list(clients))
            .agg(F.first(value, ignorenulls=True)))


def long_to_blocks(long: DataFrame, numbers: DataFrame, block_size: int, value: str = Y, ts: str = TS,
                   by: tuple[str, ...] = ()) -> DataFrame:
    """R2 in blocks: (*by, ts, block, cells), ``cells`` being the values of the
    block's series in order, NULL where there is none.  An hour has the
    blocks that any of its rows is in.  One exchange; the plan does not grow
    with the number of series."""
    rows = long.join(numbers, CLIENT).select(*by, ts, "block", "place", F.col(value).alias("_v")).repartition(ts, "block")
    one = rows.groupBy(*by, ts, "block", "place").agg(F.first("_v", ignorenulls=True).alias("_v"))
    none = F.lit(None).cast(rows.schema["_v"].dataType)
    got = one.groupBy(*by, ts, "block").agg(F.array_sort(F.collect_list(F.struct("place", "_v"))).alias("_e"))
    dense = F.aggregate("_e", F.array().cast(f"array<{rows.schema['_v'].dataType.simpleString()}>"), lambda acc, e: F.concat(
        acc, F.array_repeat(none, e["place"] - F.size(acc)), F.array(e["_v"])))
    return got.withColumn("_d", dense).select(
        *by, ts, "block", F.concat("_d", F.array_repeat(none, F.lit(block_size) - F.size("_d"))).alias("cells"))


def to_edge_names(df: DataFrame) -> DataFrame:
    """Rename to ``unique_id, ds, y`` (forecasting-library convention)."""
    return df.withColumnsRenamed({k: v for k, v in EDGE_NAMES.items() if k in df.columns})


def from_edge_names(df: DataFrame) -> DataFrame:
    inv = {v: k for k, v in EDGE_NAMES.items()}
    return df.withColumnsRenamed({k: v for k, v in inv.items() if k in df.columns})


def as_single_series(df: DataFrame, value: str, series_id: str = "aggregate") -> DataFrame:
    """P10: a one-series panel from a (ts, value) table."""
    return df.select(F.lit(series_id).alias(CLIENT), F.col(TS),
                     F.col(value).cast("float").alias(Y))
