"""Partitioning for steps whose cost is not proportional to their shuffle bytes.

Adaptive execution merges shuffle partitions by size.  That is wrong for a
table of series ids that is then exploded into one row per (series, hour): a
few bytes per series become thousands of rows, so a merged partition would run
the whole expansion in one task.  ``spread`` counts the rows and deals them
out by what they grow into, so the number of tasks follows the data, whatever
the number of cores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import CLIENT
from ..session import stored

ROWS_PER_TASK = 100_000


def spread(df: DataFrame, expansion: int, key: str = CLIENT) -> DataFrame:
    """``df``, hash-partitioned by ``key`` so that a task has about
    ``ROWS_PER_TASK`` rows once each row has become ``expansion`` rows.

    ``df`` (a row per series) is written once, counted, and dealt out with an
    explicit number of partitions, which adaptive execution does not merge.  The
    number differs from ``spark.sql.shuffle.partitions``: a repartition equal
    to an existing hash partitioning would be dropped as redundant."""
    df = stored(df, "spread")
    return df.repartition(tasks(df.sparkSession, df.count() * max(1, int(expansion))), key)


def tasks(spark: SparkSession, rows: int) -> int:
    """Number of partitions of about ``ROWS_PER_TASK`` rows."""
    n = max(1, -(-rows // ROWS_PER_TASK))
    return n + 1 if n == int(spark.conf.get("spark.sql.shuffle.partitions")) else n


def by_series(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` (the series) into tasks of about
    ``ROWS_PER_TASK`` rows.  Dense panels compress to a small part of their size
    in memory, so merging by bytes would give one task millions of rows.  The
    windows and aggregates of a series that follow share this exchange.  ``df``
    is counted: it should be a stored table or a plain selection of one."""
    return df.repartition(tasks(df.sparkSession, df.count()), *(keys or (CLIENT,)))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
            counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, both dealt out by the number of rows of
    ``counted`` (default ``left``; see :func:`by_series`) and merged.  For rows
    that are generated from a small table (forecasts from models): the planner
    sizes them like that table and would collect all of them in the driver for
    a broadcast."""
    n = tasks(left.sparkSession, (left if counted is None else counted).count())
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys, how)
