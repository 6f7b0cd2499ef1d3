"""Order-dependent helpers that stay parallel.

A plain ``lag`` over one series (or over the whole time axis) puts the series
into one task.  Here the ordering key is cut into fixed-size blocks: ``lag``
runs inside each (key, block) group, which is bounded by the block size, and
only one summary row per block (first and last position) goes through a second
window that links each block to the previous non-empty one.  A series holding
a third of all rows is then spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_in_order(df: DataFrame, keys: list[str], pos: str, block: int,
                      out: str = "prev_pos") -> DataFrame:
    """Add ``out`` = the previous value of the integer column ``pos`` within
    ``keys`` (NULL for the first row of a key).  ``pos`` must be unique per key.
    """
    b = "_blk"
    x = df.withColumn(b, F.floor(F.col(pos) / F.lit(block)).cast("long"))
    w_in = Window.partitionBy(*keys, b).orderBy(pos)
    x = x.withColumn(out, F.lag(pos).over(w_in))
    # block summary: last position per non-empty block, linked to the previous block
    last = x.groupBy(*keys, b).agg(F.max(pos).alias("_last"))
    w_blk = Window.partitionBy(*keys).orderBy(b)
    link = last.select(*keys, b, F.lag("_last").over(w_blk).alias("_carry"))
    x = x.join(link, on=[*keys, b], how="left")
    return x.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop(b, "_carry")


def dense_position(axis: DataFrame, col: str, block_of, out: str = "pos") -> DataFrame:
    """0-based rank of each distinct value of ``col`` in ascending order.

    ``block_of`` maps ``col`` to a block number (e.g. the day of a timestamp).
    Rank = row number inside the block + number of values in earlier blocks;
    only the per-block counts pass through an unpartitioned window."""
    b = "_blk"
    x = axis.select(col).distinct().withColumn(b, block_of(F.col(col)))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy(b).orderBy(col)) - 1)
    counts = x.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(b, (F.sum("_n").over(
        Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return (x.join(before, b, "left")
            .select(col, (F.coalesce("_before", F.lit(0)) + F.col("_rn")).cast("long").alias(out)))
