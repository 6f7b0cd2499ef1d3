"""What the operators on vectors share: valid rows, shards, and a query set
that streams past every shard.

A row is known by ``vec_id``; of several rows with one ``vec_id`` the one
whose other columns sort first counts.  Rows without ``vec_id`` or vector,
and rows whose vector is empty or holds a null, NaN or infinite component
take no part, nor do rows whose vector is not of the most frequent length
(of equally frequent lengths the smallest).

Rows are dealt to shards of about ``rows`` rows by a hash of ``vec_id``, so no
label, source or group of copies makes a shard large.  The query set is
repeated per shard, each task holds one shard and reads its queries batch by
batch (they are sorted behind it), so memory is bounded by the shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import materialize


def valid(table: DataFrame, vector: str, others: list[str] = (), nonzero: bool = False) -> DataFrame:
    """(vec_id long, *others, v array<double>) of the rows that take part, one
    per ``vec_id``, written to the shared folder."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), *others, v.alias("v")) \
        .where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct(*others, "v")).alias("r")).select("vec_id", "r.*")
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")) \
        .orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def shard_of(n_shards: int, key: str = "vec_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_shards)).cast("int")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), dim)


def stream(shards: DataFrame, queries: DataFrame, n_shards: int, schema: str,
           load: Callable[[pa.Table], object],
           answer: Callable[[object, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``answer(load(shard), batch)`` for every shard and batch of queries.

    ``shards`` has a column ``shard``; every query meets every shard.  Both
    are rows of one table, hash-partitioned by shard and sorted so that a
    shard's rows come before its queries: a task keeps one shard and one batch."""
    of_shard, of_query = shards.drop("shard").columns, queries.columns
    at = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    none = lambda df: F.lit(None).cast(df.schema.simpleString())
    rows = shards.select("shard", F.lit(0).alias("kind"), F.struct(*of_shard).alias("s"),
                         none(queries).alias("q"))
    asked = queries.select(at, F.lit(1).alias("kind"), none(shards.drop("shard")).alias("s"),
                           F.struct(*of_query).alias("q"))
    both = rows.unionByName(asked).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, ready = [], None, None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if shard[lo] != now:
                    held, now, ready = [], shard[lo], None
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(pa.RecordBatch.from_struct_array(part.column("s")))
                elif held:
                    ready = load(pa.Table.from_batches(held)) if ready is None else ready
                    yield answer(ready, pa.RecordBatch.from_struct_array(part.column("q")))

    return both.mapInArrow(run, schema)
