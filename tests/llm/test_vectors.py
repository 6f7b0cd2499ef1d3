"""Permutation index and hard negatives against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterframe.llm import hard_negatives, permutation_index, vectors

COLS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def random_rows(n, dim=16, seed=0, copies=0, near=0):
    """``copies`` equal and ``near`` almost equal vectors among ``n`` random ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:copies] = x[0]
    x[copies:copies + near] = x[n - 1] + rng.normal(scale=0.01, size=(near, dim)).astype(np.float32)
    ids = rng.permutation(n)
    return [(int(i), [float(c) for c in v], int(rng.integers(0, 4))) for i, v in zip(ids, x, strict=True)]


def nearest(rows, k=10):
    """{query: [(vec_id, distance)]} by brute force."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == {q for q in want if want[q]}
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got])


@pytest.mark.parametrize("copies,near", [(0, 0), (700, 0), (0, 700)])
def test_search_finds_the_nearest(spark, copies, near):
    rows = random_rows(2000, copies=copies, near=near)
    got = found(permutation_index.search(frame(spark, rows), F.col("vec_id") % 100 == 0, rows_per_shard=600, least=32))
    want = nearest(rows)
    assert recall(got, want) >= 0.95
    dist = {q: dict(v) for q, v in nearest(rows, 2000).items()}
    for q, v in got.items():
        assert v == sorted(v, key=lambda t: (t[1], t[0]))
        assert all(abs(d - dist[q][i]) < 1e-12 for i, d in v)
    if copies:                                              # ties: the smallest ids of the equal vectors
        same = sorted(r[0] for r in rows if r[1] == rows[0][1])
        for q in (i for i in same if i % 100 == 0):
            assert [i for i, _ in got[q]] == [i for i in same if i != q][:10]


def test_search_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in table.collect()]
    assert recall(found(permutation_index.search(table, F.col("vec_id") % 100 == 0)), nearest(rows)) >= 0.95


def test_similarity_is_the_footrule():
    rng = np.random.default_rng(3)
    pivots = permutation_index.Pivots(rng.normal(size=(40, 8)), 12)
    x = rng.normal(size=(50, 8))
    order = pivots.order(x)
    place = np.full((50, 40), 12)
    np.put_along_axis(place, order, np.arange(12)[None, :].repeat(50, 0), axis=1)
    files = [(np.flatnonzero(place[:, p] < 12), place[place[:, p] < 12, p]) for p in range(40)]
    shard = permutation_index.Shard(x, [np.array([i]) for i in range(50)], files, 12)
    for i in range(50):
        footrule = np.abs(place - place[i]).sum(axis=1)
        assert (12 * 13 - 2 * shard.similarity(order[i]) == footrule).all()


ODD = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1),
       (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1), (7, [1.0], 1), (None, [1.0, 0.0], 1),
       (8, [1.0, 0.5], None), (9, [1.0, 0.5], 1), (10, [0.5, 0.25], 2)]


def test_search_skips_odd_rows_and_takes_clashing_columns(spark):
    df = frame(spark, ODD).withColumn("shard", F.lit(1)).withColumn("v", F.lit("x")).withColumn("rank", F.lit(2))
    got = found(permutation_index.search(df, F.col("vec_id") % 100 == 0))
    assert [i for i, _ in got[0]] == [8, 9, 10] and set(got) == {0}
    for rows in ([], [(1, None, 1)], [(0, [1.0, 2.0], 1)]):
        out = permutation_index.search(frame(spark, rows), F.col("vec_id") % 100 == 0)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_a_few_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3000).astype(np.float32)], i % 2) for i in range(30)]
    want = nearest(rows)
    got = found(permutation_index.search(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]
    assert sorted(map(tuple, mine(frame(spark, rows)).collect())) == sorted(mined(rows))


# ------------------------------------------------------------ hard negatives

def mine(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(df.withColumn("label", label), F.col("vec_id") % 100 == 0, **more)


def mined(rows):
    """The contract by brute force, in whole Python numbers."""
    keep = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        keep[i] = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(c))) for c in v])
    out = []
    for a, (label, x) in keep.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (_, y) in keep.items() if i != a}
        best = lambda of: sorted(of, key=lambda i: (-score[i], i))  # noqa: E731, B023
        for p in best([i for i in score if keep[i][0] == label])[:5]:
            negative = [i for i in score if keep[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(best(negative)[:10], 1)]
    return out


@pytest.mark.parametrize("rows_per_shard", [150, 100_000])
def test_mined_rows_equal_brute_force(spark, rows_per_shard):
    rows = random_rows(700, dim=11, seed=2, copies=250)
    got = mine(frame(spark, rows), rows_per_shard=rows_per_shard)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))


def test_mining_skips_odd_rows_and_empty_tables(spark):
    rows = [*ODD[1:], (100, [2.0, 1.0], 1), (200, [-3.0, 2.0], 2), (11, [2.0, 1.0], 3)]
    df = frame(spark, rows).withColumn("x", F.lit(1)).withColumn("limits", F.lit("y")).withColumn("rank", F.lit(0))
    two = [r for r in rows if r[1] is not None and len(r[1]) == 2]
    assert sorted(map(tuple, mine(df).collect())) == sorted(mined(two))
    for rows in ([], [(1, None, 1)], [(0, [1.0, 2.0], 1)], [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 2)]):
        assert mine(frame(spark, rows)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 9), st.integers(0, 26), st.integers(0, 2**32 - 1))
def test_lookups_are_inner_products(dim, n, bits, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(1 << bits), (1 << bits) + 1, size=(n, dim))
    a = rng.integers(-(1 << bits), (1 << bits) + 1, size=(3, dim))
    assert (hard_negatives.scores(hard_negatives.planes_of(x), hard_negatives.subset_sums(a)) == x @ a.T).all()


def test_valid_rows_are_one_per_id(spark):
    rows = [(1, [2.0, 1.0], 5), (1, [1.0, 9.0], 5), (2, [0.0, 0.0], 5)]
    got = vectors.valid(frame(spark, rows), "embedding", ["label"]).collect()
    assert sorted((r.vec_id, r.label, r.v) for r in got) == [(1, 5, [1.0, 9.0]), (2, 5, [0.0, 0.0])]
