"""Approximate nearest neighbours with a permutation index.

A bounded sample of the vectors gives the pivots.  Every vector is represented
by the order of its nearest pivots.  The index posts it in the inverted files
of these pivots: a posting is the vector's number and the pivot's place in
its order.  A query reads the files of its own nearest pivots only.

With places cut off behind the ``prefix`` nearest pivots, Spearman's footrule
of two orders is a constant less twice the sum of ``prefix - max(place,
place)`` over the pivots they share, so summing postings ranks all vectors
by footrule distance.  The best ranked share of a shard is reranked by
Euclidean distance on the original vectors; the share is doubled until a
doubling brings no new neighbour and what comes next ranks clearly below the
neighbours found (under ``clear`` of their median).  That is what keeps
recall high among near copies, whose orders differ by little more than noise.

Vectors that are equal in all components are one entry of the index with the
smallest ids of its members, which are all that can be among the nearest
``k``; so a group of copies of any size costs one entry a shard.

Every vector is indexed; only pivots come from a sample (``sample`` rows with
the smallest hashes of their ids).

Defined results: vectors as in :mod:`.vectors`, zero vectors take no part
either; ties go to the smaller ``vec_id``; a query never finds its own
``vec_id``; with fewer candidates than ``k`` all are found, with none (or an
empty table) there are no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .frames import materialize


class Pivots:
    """The pivots, and the order of the nearest ones of any vector."""

    def __init__(self, points: np.ndarray, prefix: int):
        self.points = points
        self.prefix = min(prefix, len(points))
        self._square = (points ** 2).sum(axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the ``prefix`` nearest pivots of each row, nearest first
        (ties by number)."""
        far = self._square - 2 * (x @ self.points.T)
        if self.prefix < far.shape[1]:
            near = np.sort(np.argpartition(far, self.prefix - 1, axis=1)[:, :self.prefix], axis=1)
        else:
            near = np.broadcast_to(np.arange(far.shape[1]), far.shape)
        by = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        return np.take_along_axis(near, by, axis=1)


def choose_pivots(rows: DataFrame, n_pivots: int, prefix: int, sample: int) -> Pivots:
    """Pivots from the distinct vectors of a sample, spread by hash."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).toArrow()
    if not got.num_rows:
        return Pivots(np.zeros((0, 0)), prefix)
    points = np.array(got.column("v").to_pylist(), np.float64)
    first = np.sort(np.unique(points, axis=0, return_index=True)[1])
    return Pivots(points[first[:n_pivots]], prefix)


class Shard:
    """One shard of the index: entries, their members and the inverted files."""

    def __init__(self, x: np.ndarray, members: list[np.ndarray], files: list[tuple[np.ndarray, np.ndarray]],
                 prefix: int):
        self.x, self.files, self.prefix = x, files, prefix
        self.first = np.cumsum([0, *map(len, members)])
        self.ids = np.concatenate(members) if members else np.zeros(0, np.int64)

    def similarity(self, order: np.ndarray) -> np.ndarray:
        """Footrule, as a similarity, of every entry to an order of pivots."""
        out = np.zeros(len(self.x), np.int32)
        for place, pivot in enumerate(order.tolist()):
            who, where = self.files[pivot]
            out[who] += self.prefix - np.maximum(where, place)
        return out

    def nearest(self, own: int, query: np.ndarray, order: np.ndarray, k: int, share: float,
                least: int, clear: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``k`` nearest, best first."""
        n = len(self.x)
        similar = self.similarity(order)
        ranked = np.argsort(-similar, kind="stable")
        ids, far, like = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        done, until = 0, max(least, int(np.ceil(share * n)))
        while done < n:
            take = ranked[done:until]
            d = np.sqrt(((self.x[take] - query) ** 2).sum(axis=1))
            count = self.first[take + 1] - self.first[take]
            new = np.concatenate([self.ids[self.first[t]:self.first[t + 1]] for t in take.tolist()])
            dist, rank = np.repeat(d, count), np.repeat(similar[take], count)
            other = new != own
            new, dist = np.concatenate([ids, new[other]]), np.concatenate([far, dist[other]])
            rank = np.concatenate([like, rank[other]])
            best = np.lexsort((new, dist))[:k]
            same = done and len(ids) == k and (best < k).all()
            ids, far, like, done, until = new[best], dist[best], rank[best], until, 2 * until
            if same and similar[ranked[min(done, n) - 1]] < clear * np.median(like):
                break
        return ids, far


def build(rows: DataFrame, pivots: Pivots, k: int, rows_per_shard: int) -> tuple[DataFrame, int]:
    """The index as a table, one row per shard and inverted file, and the
    number of shards: (shard, pivot, who, place); a shard's row with
    pivot -1 holds its vectors, its members' ids and their counts."""
    n_shards = max(1, -(-rows.count() // rows_per_shard))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)          # at most ``sample`` vectors

    def post(group: pa.Table) -> pa.Table:
        table = group.sort_by("vec_id")
        dim = len(table.column("v")[0])
        ids, x = table.column("vec_id").to_numpy(), vectors.matrix(table.column("v").combine_chunks(), dim)
        _, first, entry = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(entry.reshape(-1), kind="stable")              # members in order of their ids
        cuts = np.append(np.flatnonzero(np.diff(entry.reshape(-1)[by], prepend=-1)), len(by))
        members = [ids[by[a:min(b, a + k + 1)]] for a, b in zip(cuts, cuts[1:], strict=False)]
        x = x[first]
        order = shared.value.order(x)
        who = np.repeat(np.arange(len(x), dtype=np.int32), order.shape[1])
        place = np.tile(np.arange(order.shape[1], dtype=np.int32), len(x))
        sort = np.argsort(order.reshape(-1), kind="stable")
        ends = np.searchsorted(order.reshape(-1)[sort], np.arange(len(shared.value.points) + 1))
        cut = [sort[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()] * (len(cut) + 1), pa.int32()),
            "pivot": pa.array([-1, *range(len(cut))], pa.int32()),
            "who": pa.array([np.concatenate(members).tobytes(), *(who[c].tobytes() for c in cut)], pa.binary()),
            "place": pa.array([np.array(list(map(len, members)), np.int32).tobytes(),
                               *(place[c].tobytes() for c in cut)], pa.binary()),
            "x": pa.array([x.tobytes(), *[None] * len(cut)], pa.binary())})

    index = rows.select(vectors.shard_of(n_shards).alias("shard"), "vec_id", "v") \
        .groupBy("shard").applyInArrow(post, "shard int, pivot int, who binary, place binary, x binary")
    return materialize(index, "permutation-index"), n_shards


def _load(table: pa.Table, prefix: int) -> Shard:
    files: dict[int, tuple] = {}
    for r in table.to_pylist():
        if r["pivot"] < 0:
            ids, counts = np.frombuffer(r["who"], np.int64), np.frombuffer(r["place"], np.int32)
            x = np.frombuffer(r["x"], np.float64).reshape(len(counts), -1)
        else:
            files[r["pivot"]] = (np.frombuffer(r["who"], np.int32), np.frombuffer(r["place"], np.int32))
    members = np.split(ids, np.cumsum(counts)[:-1])
    return Shard(x, members, [files[p] for p in range(len(files))], prefix)


def search(table: DataFrame, queries: Column, k: int = 10, vector: str = "embedding", n_pivots: int = 256,
           prefix: int = 96, share: float = 0.04, least: int = 128, clear: float = 0.75, sample: int = 4096,
           rows_per_shard: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for
    every row for which the condition ``queries`` (on ``vec_id``) holds."""
    rows = vectors.valid(table, vector, nonzero=True)
    pivots = choose_pivots(rows, n_pivots, prefix, sample)
    schema = "query_id long, vec_id long, score double"
    if not len(pivots.points):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, n_shards = build(rows, pivots, k, rows_per_shard)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    dim = pivots.points.shape[1]

    def answer(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, q = batch.column("vec_id").to_numpy(), vectors.matrix(batch.column("v"), dim)
        orders = shared.value.order(q)
        found = [shard.nearest(int(i), x, o, k, share, least, clear) for i, x, o in zip(own, q, orders, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(own, [len(i) for i, _ in found])),
             pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))],
            names=["query_id", "vec_id", "score"])

    asked = rows.where(queries).select("vec_id", "v")
    found = vectors.stream(index, asked, n_shards, schema, lambda t: _load(t, shared.value.prefix), answer)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
