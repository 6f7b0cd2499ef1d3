"""Panel slicing: windows, splits, lookback, chunks, cutoffs, set operations
(P1, P2, P5-P7, P11-P13, W4-W6, A15-A18, U1-U4, O2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import day_end, ntz_lit
from ..schema import CLIENT, SPLIT, TS
from .ordered import dense_position


def analysis_window(df: DataFrame, start_day: str, end_day: str, ts: str = TS) -> DataFrame:
    """``start 00:00:00 <= ts <= end + 1 day - 1 s`` (inclusive days).
    Both bounds are literals, so the predicate reaches the Parquet scan."""
    lo = F.lit(start_day).cast("date").cast("timestamp_ntz")
    hi = day_end(F.lit(end_day))
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= hi))


@dataclass(frozen=True)
class SplitBounds:
    """Chronological split bounds, each inclusive at hour grain.
    ``train_start`` / ``test_end`` may be None (open)."""
    train_end: str
    val_start: str
    val_end: str
    test_start: str
    train_start: str | None = None
    test_end: str | None = None

    def expr(self, ts: str = TS) -> F.Column:
        t = F.col(ts)

        def lit(x):
            return ntz_lit(x)

        train = t <= lit(self.train_end)
        if self.train_start:
            train = train & (t >= lit(self.train_start))
        test = t >= lit(self.test_start)
        if self.test_end:
            test = test & (t <= lit(self.test_end))
        return (F.when(train, "train")
                .when((t >= lit(self.val_start)) & (t <= lit(self.val_end)), "validation")
                .when(test, "test"))


def assign_splits(df: DataFrame, bounds: SplitBounds, ts: str = TS) -> DataFrame:
    """Add ``split``; rows outside every split are dropped."""
    return df.withColumn(SPLIT, bounds.expr(ts)).where(F.col(SPLIT).isNotNull())


def split_part(df: DataFrame, bounds: SplitBounds, name: str, ts: str = TS) -> DataFrame:
    return df.where(bounds.expr(ts) == F.lit(name))


def select_clients(df: DataFrame, clients: DataFrame) -> DataFrame:
    """Keep rows of the listed series (semi join, not a huge IN list)."""
    return df.join(clients.select(CLIENT).distinct(), CLIENT, "left_semi")


def client_slice(df: DataFrame, client: str, start_day: str, end_day: str,
                 ts: str = TS) -> DataFrame:
    """One series and an inclusive range of calendar days."""
    d = F.to_date(F.col(ts))
    return df.where((F.col(CLIENT) == F.lit(client))
                    & (d >= F.lit(start_day).cast("date")) & (d <= F.lit(end_day).cast("date")))


def split_at(df: DataFrame, cutoff, ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """(rows before ``cutoff``, rows at or after it)."""
    c = ntz_lit(cutoff)
    return df.where(F.col(ts) < c), df.where(F.col(ts) >= c)


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a missing value."""
    return df.na.drop("any", subset=cols)


def keep_timestamps(df: DataFrame, wanted: DataFrame, ts: str = TS) -> DataFrame:
    """Keep rows whose timestamp is in ``wanted`` (semi join)."""
    return df.join(wanted.select(ts).distinct(), ts, "left_semi")


def lookback(df: DataFrame, n: int, ts: str = TS) -> DataFrame:
    """The last ``n`` rows of each series; shorter series are kept whole.
    ``row_number <= n`` becomes a WindowGroupLimit that trims each partition
    before the shuffle."""
    w = Window.partitionBy(CLIENT).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def horizon(df: DataFrame, ts: str = TS) -> int:
    """Number of distinct timestamps (exact)."""
    return df.select(ts).distinct().count()


def chunk_index(wanted: DataFrame, chunk: int, ts: str = TS, out: str = "chunk") -> DataFrame:
    """Distinct wanted timestamps in order, cut into slices of ``chunk``.
    Output ``ts, pos, chunk``."""
    pos = dense_position(wanted, ts, lambda c: F.to_date(c))
    return pos.withColumn(out, F.floor(F.col("pos") / F.lit(chunk)).cast("long"))


def nth_last_timestamp(df: DataFrame, n: int, ts: str = TS) -> DataFrame:
    """Per series the ``n``-th last timestamp (series shorter than ``n``
    have none).  Output ``client_id, ts``."""
    w = Window.partitionBy(CLIENT).orderBy(F.col(ts).desc())
    return (df.select(CLIENT, ts).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == n).select(CLIENT, ts))


def in_sample_cutoff(df: DataFrame, n: int, ts: str = TS) -> DataFrame:
    """The smallest per-series ``n``-th last timestamp (one row)."""
    return nth_last_timestamp(df, n, ts).agg(F.min(ts).alias("cutoff"))


def split_profile(df: DataFrame) -> DataFrame:
    """Per split rows, series, timestamps and time range."""
    return (df.groupBy(SPLIT)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_distinct(CLIENT).alias("series"),
                 F.count_distinct(TS).alias("timestamps"),
                 F.min(TS).alias("start"), F.max(TS).alias("end")))


def client_list(df: DataFrame) -> DataFrame:
    """Distinct series ids, sorted (lexicographic)."""
    return df.select(CLIENT).distinct().orderBy(CLIENT)


def union_history(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def remaining_timestamps(wanted: DataFrame, covered: DataFrame, ts: str = TS) -> DataFrame:
    """Wanted timestamps not yet covered."""
    return wanted.select(ts).distinct().join(covered.select(ts).distinct(), ts, "left_anti")


def split_overlap(df: DataFrame) -> DataFrame:
    """U4 check: timestamps that occur in more than one split (must be empty)."""
    return (df.select(SPLIT, TS).distinct().groupBy(TS)
            .agg(F.count(F.lit(1)).alias("splits")).where(F.col("splits") > 1))


def sort_by_series(df: DataFrame, ts: str = TS) -> DataFrame:
    """O2: cluster by series, ordered by time inside each partition (no
    global sort)."""
    return df.repartition(CLIENT).sortWithinPartitions(CLIENT, ts)

