"""Toxicity grades by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(theta_k - w.x)``: all thresholds share one weight
vector, and the thresholds are ordered.  ``x`` are sparse text features: for
each hashed word of the document that was selected in training,
``1 + log(1 + 100 * share of the words)``.

Labels say only whether a document is toxic.  Their grades are derived from
the text: words that are significantly more frequent in toxic documents are
the selected features; toxic documents are graded 1 to ``grades`` by the
quantile of their features' sum, each weighted by its word's log-odds.

Fitting uses a bounded sample of labelled rows (``Settings.max_rows``, by hash
of the id) as word counts; scoring reads every text once with one weight per
bucket.

Defined results: NULL and empty texts have no features and the thresholds'
probabilities; repeated rows are scored alike; a document with several labels
takes the larger one; without labelled rows of both kinds all severities are 0.
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
from .lexer import ALNUM_WORDS, U64, blocks, words


@dataclass(frozen=True)
class Settings:
    bits: int = 18           # 2**bits word buckets
    grades: int = 3          # grades above 0
    max_rows: int = 6000     # labelled rows used for fitting, at most
    significance: float = 3.5  # standard errors by which a word's log-odds must exceed 0
    steps: int = 2000
    rate: float = 0.1
    decay: float = 1e-6


@dataclass(frozen=True)
class Model:
    weight: np.ndarray       # per bucket, 0 if not selected
    theta: np.ndarray        # ordered thresholds
    settings: Settings


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _word_counts(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and count of every distinct word, and words per document."""
    w = words(col, ALNUM_WORDS, lower=True)
    key = (w.doc_of_word() << bits) | (w.hash >> U64(64 - bits)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n, w.counts()


def _value(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 1 + np.log1p(100 * count / np.maximum(total, 1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, s: Settings) -> DataFrame:
    """(doc_id, y, n_words, ids, counts) of the sampled labelled rows."""
    bits = s.bits
    rows = labelled_sample(docs, labels, label, s.max_rows).select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in blocks(b.column("text")):
                part = b.slice(lo, hi - lo)
                doc, bucket, n, total = _word_counts(part.column("text"), bits)
                at = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array(total.astype(np.int64)),
                     pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))],
                    names=["doc_id", "y", "n_words", "ids", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, y int, n_words long, ids array<int>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings | None = None) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` marks; the caller decides
    which rows may be learned from."""
    s = settings or Settings()
    size, none = 1 << s.bits, Model(np.zeros(1 << s.bits), np.full(s.grades, 40.0), s)
    got = training_rows(docs, labels, label, s).orderBy("doc_id").toArrow().combine_chunks()
    y = got.column("y").to_numpy() if got.num_rows else np.zeros(0)
    if not 0 < (y > 0).sum() < len(y):
        return none
    ids_col, counts_col = got.column("ids").combine_chunks(), got.column("counts").combine_chunks()
    ids, counts = ids_col.values.to_numpy(), counts_col.values.to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(ids_col.offsets.to_numpy()))
    total = got.column("n_words").to_numpy()

    # selection: log-odds of document frequency in toxic against other documents
    toxic = y > 0
    df = np.bincount(ids, minlength=size)
    hit = np.bincount(ids[toxic[row]], minlength=size)
    miss, n1, n0 = df - hit, toxic.sum(), (~toxic).sum()
    odds = np.log((hit + 0.5) / (n1 - hit + 0.5)) - np.log((miss + 0.5) / (n0 - miss + 0.5))
    error = np.sqrt(1 / (hit + 0.5) + 1 / (n1 - hit + 0.5) + 1 / (miss + 0.5) + 1 / (n0 - miss + 0.5))
    strong = np.flatnonzero((hit >= 3) & (odds > s.significance * error))
    if not len(strong):
        return none
    place = np.full(size, -1)
    place[strong] = np.arange(len(strong))
    keep = place[ids] >= 0
    row, feature, count = row[keep], place[ids[keep]], counts[keep]
    x = _value(count, total[row])
    raw = np.bincount(row, weights=odds[strong][feature] * x, minlength=len(y))
    cuts = np.quantile(raw[toxic], np.arange(1, s.grades) / s.grades)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, raw, "right"), 0)

    # thresholds theta_1 < theta_2 < ..., kept ordered by positive gaps
    w, first, gaps = odds[strong] / odds[strong].max(), 1.0, np.zeros(s.grades - 1)
    state = [np.zeros(len(strong) + s.grades) for _ in range(2)]
    at = np.arange(len(y))
    for t in range(1, s.steps + 1):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, weights=w[feature] * x, minlength=len(y))
        p = np.concatenate([np.zeros((len(y), 1)), _sigmoid(theta[None, :] - z[:, None]), np.ones((len(y), 1))], axis=1)
        slope = p * (1 - p)
        lo, hi = p[at, grade], p[at, grade + 1]
        q = np.maximum(hi - lo, 1e-9)
        dz = (slope[at, grade + 1] - slope[at, grade]) / q             # of minus log-likelihood, by z
        dtheta = np.zeros((len(y), s.grades + 2))
        dtheta[at, grade + 1] -= slope[at, grade + 1] / q
        dtheta[at, grade] += slope[at, grade] / q
        dtheta = dtheta[:, 1:-1].mean(axis=0)
        dw = np.bincount(feature, weights=dz[row] * x, minlength=len(w)) / len(y) + s.decay * w
        after = np.cumsum(dtheta[::-1])[::-1]
        g = np.concatenate([dw, [after[0]], after[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = s.rate * (state[0] / (1 - 0.9 ** t)) / (np.sqrt(state[1] / (1 - 0.99 ** t)) + 1e-8)
        w, first, gaps = w - step[:len(w)], first - step[len(w)], gaps - step[len(w) + 1:]
    weight = np.zeros(size)
    weight[strong] = w
    return Model(weight, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), s)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a struct column ``toxicity`` appended: expected severity
    (0 to ``grades``), the most likely grade and the probability of any grade
    above 0.  If the name is taken, underscores are added."""
    name = free_name(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 2**bits numbers
    schema = docs.select("*", F.struct(F.lit(0.0).alias("severity"), F.lit(0).alias("grade"),
                                       F.lit(0.0).alias("p_toxic")).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [np.zeros(0)]
            for lo, hi in blocks(b.column("text")):
                w = words(b.column("text").slice(lo, hi - lo), ALNUM_WORDS, lower=True)
                bucket = (w.hash >> U64(64 - m.settings.bits)).astype(np.int64)
                at = np.flatnonzero(m.weight[bucket])                 # most words are not selected
                doc = np.searchsorted(w.first, at, "right") - 1
                key, n = np.unique((doc << m.settings.bits) | bucket[at], return_counts=True)
                doc, bucket = key >> m.settings.bits, key & ((1 << m.settings.bits) - 1)
                scores.append(np.bincount(doc, weights=m.weight[bucket] * _value(n, w.counts()[doc]),
                                          minlength=hi - lo))
            z = np.concatenate(scores)
            above = _sigmoid(z[:, None] - m.theta[None, :])           # P(grade >= k), k = 1 ..
            p = -np.diff(np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1), axis=1)
            added = pa.StructArray.from_arrays(
                [pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0])],
                names=["severity", "grade", "p_toxic"])
            yield pa.RecordBatch.from_arrays([*b.columns, added], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
