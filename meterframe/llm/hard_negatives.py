"""Hard negatives by exact integer scores from subset-sum tables.

Components become whole numbers, floor(scale * x).  A shard keeps its
candidates as bit planes: for each group of eight dimensions and each bit of
the two's complement numbers, one byte packs that bit of the eight
dimensions.  For an anchor, a table of 256 entries per group holds the sum
of every subset of its eight components.  A byte then looks up what its bit
plane adds to the inner product, and planes are joined from the highest
(which counts negative) to the lowest by shift and add: the full exact inner
product without a multiplication.

The best positives of all anchors come from the rows of their label, shard by
shard, then from the best of all shards.  A second pass scores the rows of
the other labels against the thresholds that the positives set.  Every pair
of anchor and row is scored once, in one of the passes.

Defined results: vectors as in :mod:`.vectors`; rows with a null label take no
part.  A component whose whole number is beyond 27 bits could overflow a long
score; such rows take no part either.  Ties go to the smaller ``vec_id``.
An anchor without positives, or a positive without rows in its range, has no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors

_BITS = 27
_ANCHORS = 32              # anchors whose tables are looked up together
_ROWS = 2048               # candidates per block


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers (rows x dimensions): bytes by plane (the
    lowest first), group of eight dimensions and row."""
    bits = max(int(v).bit_length() for v in (x.max(initial=0), -x.min(initial=0) - 1, 0)) + 1
    wide = np.zeros((x.shape[0], -(-x.shape[1] // 8) * 8), np.int64)
    wide[:, :x.shape[1]] = x
    return np.stack([np.packbits(((wide >> b) & 1).astype(bool), axis=1, bitorder="little").T for b in range(bits)])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables of the anchors: group x byte x anchor."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dim] = anchors
    out = np.zeros((groups, 256, n), np.int64)
    for i in range(8):                                   # subsets with dimension i: those without, plus its component
        out[:, 1 << i:2 << i] = out[:, :1 << i] + wide[:, i::8].T[:, None, :]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products, candidate x anchor, by lookups, shifts and additions."""
    total = None
    for plane in planes[::-1]:
        part = tables[0][plane[0]]
        for g in range(1, len(plane)):
            part = part + tables[g][plane[g]]
        total = -part if total is None else (total << 1) + part
    return total


class Shard:
    """Candidates of a shard, sorted by label and id, as bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        by = np.lexsort((ids, labels))
        self.ids, self.labels = ids[by], labels[by]
        self.planes = planes_of(x[by])

    def score(self, anchors: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Scores of candidates lo..hi, one column per anchor."""
        out = np.empty((hi - lo, len(anchors)), np.int64)
        for a in range(0, len(anchors), _ANCHORS):
            tables = subset_sums(anchors[a:a + _ANCHORS])
            for r in range(lo, hi, _ROWS):
                end = min(hi, r + _ROWS)
                out[r - lo:end - lo, a:a + _ANCHORS] = scores(self.planes[:, :, r:end], tables)
        return out

    def label_range(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(score) > 4 * k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= limit)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _load(table: pa.Table) -> Shard:
    x = table.column("x").combine_chunks()
    return Shard(table.column("vec_id").to_numpy(), table.column("label").to_numpy(),
                 x.flatten().to_numpy().reshape(table.num_rows, -1))


def _anchors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _positives(k: int):
    def answer(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, label, x = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _anchors(batch)
        rows: list[tuple] = []
        for one in np.unique(label).tolist():
            lo, hi = shard.label_range(one)
            of = np.flatnonzero(label == one)
            for a in range(0, len(of), _ANCHORS):
                some = of[a:a + _ANCHORS]
                found = shard.score(x[some], lo, hi)
                for j, i in enumerate(some.tolist()):
                    other = np.flatnonzero(shard.ids[lo:hi] != own[i])
                    best = other[_first(shard.ids[lo + other], found[other, j], k)]
                    rows += [(own[i], shard.ids[lo + r], found[r, j]) for r in best.tolist()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=["anchor_id", "positive_id", "positive_score"])
    return answer


def _negatives(k: int, low: int, high: int):
    def answer(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, label, x = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _anchors(batch)
        limits = batch.column("limits").to_pylist()
        rows: list[tuple] = []
        for a in range(0, len(own), _ANCHORS):
            some = range(a, min(len(own), a + _ANCHORS))
            lowest = {i: shard.label_range(int(label[i])) for i in some}
            found = np.empty((len(shard.ids), len(some)), np.int64)
            for one in np.unique(label[a:a + _ANCHORS]).tolist():
                lo, hi = shard.label_range(one)
                of = np.array([i for i in some if label[i] == one])
                for p, q in ((0, lo), (hi, len(shard.ids))):            # the rows of its own label are left out
                    if p < q:
                        found[p:q, of - a] = shard.score(x[of], p, q)
            for i in some:
                lo, hi = lowest[i]
                ids = np.concatenate([shard.ids[:lo], shard.ids[hi:]])
                score = np.concatenate([found[:lo, i - a], found[hi:, i - a]])
                for limit in limits[i]:
                    at = np.flatnonzero((low * limit <= 100 * score) & (100 * score <= high * limit))
                    best = at[_first(ids[at], score[at], k)]
                    rows += [(own[i], limit, ids[r], score[r]) for r in best.tolist()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=["anchor_id", "positive_score", "negative_id", "negative_score"])
    return answer


def mine(table: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30,
         high: int = 90, scale: int = 256, vector: str = "embedding", rows_per_shard: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for every row for which the condition ``anchors`` (on
    ``vec_id``) holds: its ``n_positives`` best rows of the same label, and for
    each the ``n_negatives`` best rows of other labels whose score is between
    ``low`` and ``high`` per cent of the positive's."""
    rows = vectors.valid(table.where("label is not null").withColumn("label", F.col("label").cast("int")),
                         vector, ["label"])
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    rows = rows.where(~F.exists("v", lambda x: F.abs(F.floor(x * float(scale))) >= F.lit(1 << _BITS))) \
        .select("vec_id", F.col("label").cast("long").alias("label"), whole.alias("x"))
    n_shards = max(1, -(-rows.count() // rows_per_shard))
    shards = rows.select(vectors.shard_of(n_shards).alias("shard"), "vec_id", "label", "x")
    asked = rows.where(anchors)
    got = vectors.stream(shards, asked, n_shards, "anchor_id long, positive_id long, positive_score long",
                         _load, _positives(n_positives))
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    positives = vectors.materialize(
        got.withColumn("place", place).where(F.col("place") <= n_positives).drop("place"), "positives")
    limits = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("limits"))
    asked = asked.join(limits, asked.vec_id == limits.anchor_id).select("vec_id", "label", "x", "limits")
    got = vectors.stream(shards, asked, n_shards,
                         "anchor_id long, positive_score long, negative_id long, negative_score long",
                         _load, _negatives(n_negatives, low, high))
    rank = F.row_number().over(
        Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    best = got.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return positives.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
