"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its features: hashed words,
hashed pairs of neighbouring words and hashed character n-grams (3 to 5 bytes
within a run of non-space bytes).  A softmax layer on that average predicts
the label.  Vectors and layer are learned together by plain NumPy stochastic
gradient descent, on a bounded sample of labelled rows
(``Settings.max_rows``, chosen by hash of the id); feature hashing runs in
Spark tasks, so the trainer receives feature ids and counts, not texts.

Because the softmax is over two classes and the average is linear, a trained
model scores a document as the mean of one number per feature bucket.  Scoring
is therefore one pass with a table of ``2**bits`` numbers.

Defined results: NULL and empty texts have no features and get the bias's
score; repeated rows are scored alike; a document with several labels takes
the larger one; without labelled rows every score is 0.5.
Texts of any length
are scored whole; an empty table gives an empty result; clashing columns keep
their values, the operator's own gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import free_name, labelled_sample
from .lexer import SPACE_WORDS, U64, blocks, mix, words


@dataclass(frozen=True)
class Settings:
    bits: int = 17            # 2**bits feature buckets
    dim: int = 16             # vector length
    max_rows: int = 4000      # labelled rows used for training, at most
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7


_GRAMS = (3, 4, 5)
_REPEAT = U64(0x51ED270B)


def _features(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket of every feature of a block and the document it belongs to."""
    w = words(col, SPACE_WORDS)
    shift = U64(64 - bits)
    doc = w.doc_of_word()
    ids, docs = [(w.hash >> shift)], [doc]
    if len(w.hash) > 1:
        a, b = w.hash[:-1], w.hash[1:]
        pair = mix(a * U64(3) + b)
        pair[a == b] = _REPEAT << U64(32)          # one bucket for "the same word again"
        same = doc[:-1] == doc[1:]
        ids.append(pair[same] >> shift)
        docs.append(doc[:-1][same])
    data = w.data.astype(np.uint64)
    space = ~SPACE_WORDS[w.data]
    owner = np.full(len(w.data), -1, np.int32)
    owner[w.start] = 1
    run = np.cumsum(owner == 1) - 1                # index of the word a byte lies in
    for n in _GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * U64(0x100000001B3) + data[k:m + k]
        at = np.flatnonzero((run[:m] == run[n - 1:]) & ~space[:m] & ~space[n - 1:])
        ids.append(mix(h[at]) >> shift)
        docs.append(doc[run[at]])
    return np.concatenate(ids).astype(np.int64), np.concatenate(docs), w.n_docs


def training_rows(docs: DataFrame, labels: DataFrame, label: str, s: Settings) -> DataFrame:
    """(y, ids, counts): distinct features with counts of the sampled labelled rows."""
    rows = labelled_sample(docs, labels, label, s.max_rows).select("doc_id", "y", "text")
    bits = s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in blocks(b.column("text"), 1 << 20):
                f, d, n = _features(b.column("text").slice(lo, hi - lo), bits)
                key, count = np.unique((d.astype(np.int64) << bits) | f, return_counts=True)
                at = np.searchsorted(key >> bits, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo).cast(pa.int32()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()),
                                              pa.array((key & ((1 << bits) - 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(count.astype(np.int32)))],
                    names=["doc_id", "y", "ids", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, y int, ids array<int>, counts array<int>")


@dataclass(frozen=True)
class Model:
    table: np.ndarray    # contribution of each bucket to the logit
    bias: float
    settings: Settings


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings | None = None) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks; the caller
    decides which rows may be learned from.  At most ``max_rows`` rows reach
    the driver, as feature ids."""
    s = settings or Settings()
    got = training_rows(docs, labels, label, s).toArrow().combine_chunks()
    n, size = got.num_rows, 1 << s.bits
    if not n:
        return Model(np.zeros(size, np.float32), 0.0, s)
    order = np.argsort(got.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")   # same model each time
    y = got.column("y").to_numpy()
    ids_col, counts_col = got.column("ids").combine_chunks(), got.column("counts").combine_chunks()
    at = ids_col.offsets.to_numpy()
    ids, counts = ids_col.values.to_numpy(), counts_col.values.to_numpy()
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 1.0 / s.dim, (size, s.dim)).astype(np.float32)
    out = np.zeros((2, s.dim), np.float32)
    bias = np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2)[:2] / n
    weight = 0.5 / np.maximum(share, 1e-3)                # rare labels count as much as common ones
    weight = np.minimum(weight, 8.0)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(order):
            lo, hi = at[i], at[i + 1]
            if lo == hi:
                continue
            f, c = ids[lo:hi], counts[lo:hi].astype(np.float32)
            c /= c.sum()
            doc = c @ emb[f]
            z = out @ doc + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p.copy()
            g[int(y[i])] -= 1
            g *= weight[int(y[i])] * rate
            back = out.T @ g
            out -= np.outer(g, doc)
            bias -= 0.1 * g
            # a feature's gradient is its share; scaled up so that rare features move
            emb[f] -= (np.sqrt(c)[:, None]) * back[None, :]
    diff = out[1] - out[0]
    # undo the label weights in the bias, so that 0.5 separates the labels as they occur
    prior = float(np.log(weight[0] / weight[1])) if share.min() > 0 else 0.0
    return Model((emb @ diff).astype(np.float32), float(bias[1] - bias[0]) + 0.5 * prior, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a struct column ``quality`` (score, predicted) appended;
    if the name is taken, underscores are added."""
    name = free_name(docs, "quality")
    table = docs.sparkSession.sparkContext.broadcast(model.table)     # 2**bits floats
    bias, bits = model.bias, model.settings.bits
    schema = docs.select("*", F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            logits = []
            for lo, hi in blocks(b.column("text"), 1 << 20):
                f, d, n = _features(b.column("text").slice(lo, hi - lo), bits)
                total = np.bincount(d, weights=t[f], minlength=n)
                logits.append(total / np.maximum(np.bincount(d, minlength=n), 1))
            z = (np.concatenate(logits) if logits else np.zeros(0)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            added = pa.StructArray.from_arrays([pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                               names=["score", "predicted"])
            yield pa.RecordBatch.from_arrays([*b.columns, added], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
