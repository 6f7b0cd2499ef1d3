"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, by the
forward algorithm; a text's log-likelihood is the sum over its words.  The
prediction is the language with the largest posterior under equal priors.

Training is expectation-maximisation over all learning texts: Spark reduces
them to (language, word, count), forward-backward gives the expected number
of uses of every piece, and the sums over all words are the next
probabilities.  Tables sent to tasks have one number per piece and language.

Words are maximal runs of letters, lower-cased, with the vocabulary's
word-begin mark.  A character that is no piece by itself has a fixed small
probability, so every word has a segmentation.

Blocks of words go through the recursion at once, place by place; piece
identities come from a rolling hash of the characters, which is only carried
on while the characters begin some piece.

Defined results: ``und`` with score 0 for NULL text, a text without letters,
or if nothing was learned; ties go to the language that sorts first; repeated
rows repeat their result, and repeated learning rows count each time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import free_name, materialize
from .piece_lattice import MARK, PieceLattice, Pieces, blocks

_LETTERS = regex.compile(r"\p{L}+")
_MEMO = 1 << 18            # words a task remembers


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


_known: dict[int, Pieces] = {}


def known_pieces(pieces: list[str]) -> Pieces:
    """Kept by the worker from task to task (one fixed vocabulary)."""
    key = hash(tuple(pieces))
    if key not in _known:
        _known.clear()
        _known[key] = Pieces(pieces)
    return _known[key]


def vocabulary(path: str | None = None) -> list[str]:
    """Ordinary pieces of a SentencePiece model file (the public 32k one by default)."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Lattice(PieceLattice):
    """Sums over all segmentations."""

    def _sums(self, to: np.ndarray, other: np.ndarray, p: np.ndarray, near: int, log: bool) -> np.ndarray:
        """Sums over the paths at every place, for the arcs' probabilities ``p``
        (one row per arc), with ``log`` as logarithms.  These are summed relative
        to the place ``near``, which is always reachable."""
        step = to - self.first[self.word]
        order = np.argsort(step * len(self.first) + self.word, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(self.steps + 2)).tolist()
        to, other, p = to[order], other[order], p[order]
        begins = np.diff(to, prepend=-1) != 0
        out = np.zeros((self.n_places, *p.shape[1:])) if log else np.ones((self.n_places, *p.shape[1:]))
        steps = list(zip(cuts[:-1], cuts[1:], strict=True))
        for lo, hi in steps if near < 0 else steps[::-1]:
            if lo == hi:
                continue
            at = np.flatnonzero(begins[lo:hi])
            t, x = to[lo:hi], out[other[lo:hi]]
            if log:
                x = np.exp(x - out[t + near])
            x *= p[lo:hi]
            x = np.add.reduceat(x, at, axis=0)
            t = t[at]
            out[t] = out[t + near] + np.log(x) if log else x
        return out

    def forward(self, p: np.ndarray, log: bool) -> np.ndarray:
        """Summed over all ways from the beginning of the word to each place."""
        return self._sums(self.end, self.start, p, -1, log)

    def backward(self, p: np.ndarray, log: bool) -> np.ndarray:
        """Summed over all ways from each place to the end of the word."""
        return self._sums(self.start, self.end, p, 1, log)

    def needs_logs(self, table: np.ndarray) -> bool:
        """Whether a product of probabilities of the table could leave the range of numbers."""
        return self.steps * -np.log(table.min()) > 600


def log_likelihood(words: list[str], known: Pieces, table: np.ndarray) -> np.ndarray:
    """Log of the summed segmentation probabilities: one row per word, one
    column per language.  ``table`` has a row per piece (0: unknown)."""
    out = np.zeros((len(words), table.shape[1]))
    for part in blocks(words):
        lattice = Lattice([MARK + words[i] for i in part.tolist()], known)
        log = lattice.needs_logs(table)
        ahead = lattice.forward(table[lattice.number], log)[lattice.last]
        out[part] = ahead if log else np.log(ahead)
    return out


def expected_uses(words: list[str], language: np.ndarray, count: np.ndarray, known: Pieces,
                  table: np.ndarray) -> np.ndarray:
    """Forward-backward: expected uses of each piece, per language, over all
    segmentations of the words (each with its language and count)."""
    size, n_lang = table.shape
    uses = np.zeros(size * n_lang)
    for part in blocks(words):
        lattice = Lattice([MARK + words[i] for i in part.tolist()], known)
        which = lattice.number * n_lang + language[part][lattice.word]
        p, log = table.reshape(-1)[which], lattice.needs_logs(table)
        ahead, back = lattice.forward(p, log), lattice.backward(p, log)
        total = ahead[lattice.last][lattice.word]
        ahead, back = ahead[lattice.start], back[lattice.end]
        share = p * (np.exp(ahead + back - total) if log else ahead * back / total)
        uses += np.bincount(which, weights=share * count[part][lattice.word], minlength=len(uses))
    return uses.reshape(size, n_lang)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: list[str]
    table: np.ndarray      # probability of piece (row; 0 is the unknown character) in language (column)


UNKNOWN = 1e-8


def _normalise(uses: np.ndarray, smooth: float) -> np.ndarray:
    table = uses + smooth
    table[0] = 0
    table /= table.sum(axis=0, keepdims=True)
    table[0] = UNKNOWN
    return table


def train(docs: DataFrame, path: str | None = None, rounds: int = 2, smooth: float = 0.05) -> Model:
    """Learn from (text, lang) of ``docs``; rows without language are skipped.
    Nothing but tables of vocabulary size per language reaches the driver."""
    spark = docs.sparkSession
    pieces = vocabulary(path)
    shared = spark.sparkContext.broadcast(pieces)          # the fixed vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            for lo in range(0, b.num_rows, 2000):
                seen: dict[str, Counter] = {}
                for lang, text in zip(langs[lo:lo + 2000], b.column("text").slice(lo, 2000), strict=True):
                    seen.setdefault(lang, Counter()).update(letter_words(text.as_py()))
                rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    seen = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text") \
        .mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "lang-words")
    languages = sorted(r[0] for r in seen.select("lang").distinct().collect())
    size = len(pieces) + 1
    table = _normalise(np.ones((size, max(1, len(languages)))), smooth)
    if not languages:
        return Model([], pieces, table)
    for _ in range(rounds):
        current = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            known, place = known_pieces(shared.value), {x: i for i, x in enumerate(languages)}
            uses = np.zeros(current.value.shape)
            for b in batches:
                lang = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
                if len(lang):
                    uses += expected_uses(b.column("word").to_pylist(), lang, b.column("n").to_numpy(), known,
                                          current.value)
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(uses[piece, lang])],
                names=["piece", "lang", "uses"])

        got = seen.mapInArrow(expect, "piece int, lang int, uses double").groupBy("piece", "lang") \
            .agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros_like(table)
        uses[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("uses").to_numpy()
        table = _normalise(uses, smooth)
    return Model(languages, pieces, table)


class Scorer:
    """Scores texts; remembers the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, known_pieces(model.pieces)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood per text and language, and the number of words."""
        found = [letter_words(t) for t in texts]
        if len(self.place) > _MEMO:
            self.place, self.rows = {}, self.rows[:0]
        new = list(dict.fromkeys(w for ws in found for w in ws if w not in self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(
                log_likelihood(new[i:i + 50_000], self.known, self.model.table) for i in range(0, len(new), 50_000))])
        n = np.array([len(ws) for ws in found], np.int64)
        out = np.zeros((len(texts), len(self.model.languages)))
        for i, ws in enumerate(found):
            if ws:
                out[i] = self.rows[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        return out, n


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a struct column ``language`` (lang, score) appended; if
    the name is taken, underscores are added.  The score is the posterior."""
    name = free_name(docs, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)       # vocabulary x languages
    schema = docs.select("*", F.struct(F.lit("").alias("lang"), F.lit(0.0).alias("score")).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value.languages else None
        names = shared.value.languages
        for b in batches:
            lang, score = [], []
            for lo in range(0, b.num_rows, 500):
                texts = b.column("text").slice(lo, 500).to_pylist()
                if scorer is None:
                    lang += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                logs, n = scorer.totals(texts)
                p = np.exp(logs - logs.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang += [names[k] if c else "und" for k, c in zip(best, n, strict=True)]
                score += [float(p[i, k]) if n[i] else 0.0 for i, k in enumerate(best)]
            added = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                               names=["lang", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, added], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
