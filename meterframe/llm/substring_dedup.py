"""Substring dedup: passages that recur anywhere are cut out.

A window is ``window`` (35) consecutive words of a document; it recurs if the
same words also start somewhere else.  Every word covered by a recurring
window is removed, the first occurrence included.

1. *Anchors.*  The anchor of a window is its phrase of ``phrase`` words with
   the smallest hash (leftmost on ties).  Equal windows have equal anchors,
   so only windows whose anchor occurs twice can recur.  Neighbouring windows
   with the same anchor form a run; a run costs one row, about one row for 14
   words.
2. *Confirmation.*  Documents are dealt into shards of bounded size and meet
   the recurring anchors of their shard.  Runs whose words occur twice are
   confirmed as they are; runs of other recurring anchors are compared window
   by window.  Both are counts over all documents with partial aggregation.
3. *Automata.*  Each shard compiles its confirmed passages (runs of
   neighbouring confirmed windows) into Aho-Corasick automata over words, and
   streams its documents through them; every occurrence found is removed.

Only documents with a recurring anchor go through step 3, the others are
answered in step 2.  Counting is by a pair of 64-bit hashes (anchor and run
or window); the automata compare the words themselves.

Defined results: NULL and empty texts have no words; documents shorter than a
window keep everything; repeated rows are separate documents, so their
windows recur.
Texts of any length are searched whole; an empty table gives an
empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize
from .lexer import SPACE_WORDS, U64, Words, blocks, mix, phrase_hash, powers, words

#: Bytes of text in one shard, on average; bounds what one task holds.
SHARD_BYTES = 2 << 20
_SEGMENT = 1 << 22                      # windows whose anchors are searched at a time
_POS_BITS = 24
#: Words of one automaton, at most (one code point stands for a word).
_ALPHABET = 1_000_000


def _range_hash(total: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, q = powers(len(total))
    return mix((total[e] - total[s]) * q[s])


class Runs:
    """Runs of windows of a block: anchor, span hash, first window, number of
    windows; and the hash of any window."""

    def __init__(self, w: Words, window: int, phrase: int):
        self.window, self.words = window, w
        n = len(w.hash)
        count = w.counts()
        # windows that lie in one document
        start = np.zeros(n + 1, np.int32)
        ok = count >= window
        np.add.at(start, w.first[:-1][ok], 1)
        np.add.at(start, w.first[1:][ok] - window + 1, -1)
        valid = np.flatnonzero(np.cumsum(start[:n])) if n else np.zeros(0, np.int64)
        h = phrase_hash(w.hash, phrase)
        wide = window - phrase + 1
        pos = np.zeros(max(0, n - window + 1), np.int64)
        for lo in range(0, len(pos), _SEGMENT):
            hi = min(len(pos), lo + _SEGMENT)
            part = h[lo:hi + wide - 1]
            key = (part >> U64(_POS_BITS) << U64(_POS_BITS)) | np.arange(len(part), dtype=np.uint64)
            width = 1
            while 2 * width <= wide:                      # minimum over 2, 4, 8, ... phrases
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if width < wide:
                key = np.minimum(key[:len(key) - (wide - width)], key[wide - width:])
            pos[lo:hi] = lo + (key & U64((1 << _POS_BITS) - 1)).astype(np.int64)
        p = pos[valid]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        at = np.flatnonzero(new)
        self.first = valid[at]
        self.size = np.diff(np.append(at, len(p)))
        self.anchor = h[p[at]] if len(at) else np.zeros(0, U64)
        table, _ = powers(n + 1)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(w.hash * table[:n], out=self.total[1:])
        self.span = _range_hash(self.total, self.first, self.first + self.size - 1 + window)
        self.doc = np.searchsorted(w.first, self.first, "right") - 1

    def window_hash(self, s: np.ndarray) -> np.ndarray:
        return _range_hash(self.total, s, s + self.window)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every window of the given runs, and each window's place in ``runs``."""
        n = self.size[runs]
        owner = np.repeat(np.arange(len(runs)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.first[runs][owner] + inner, owner


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership of ``values`` in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _distinct(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of every distinct pair, and how often it occurs (``n`` times at each place)."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat((np.ones(len(a), np.int64) if n is None else n)[order], first) \
        if len(order) else np.zeros(0, np.int64)


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _text(kept: list[bytes]) -> str:
    return b" ".join(kept).decode("utf-8")


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def locate(docs: list[list[bytes]], passages: list[tuple[bytes, ...]]) -> list[np.ndarray]:
    """For each document (a list of words) the words inside occurrences of the
    passages, as a mask.  The passages are split over as many automata as
    their words need code points."""
    covered = [np.zeros(len(d) + 1, np.int64) for d in docs]
    todo = sorted(set(passages))
    while todo:
        code: dict[bytes, str] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        rest = len(todo)
        for i, passage in enumerate(todo):
            if len(code) + len(passage) > _ALPHABET and code:
                rest = i
                break
            for word in passage:
                if word not in code:
                    k = len(code) + 1
                    code[word] = chr(k if k < 0xD800 else k + 0x800)     # no surrogates
            machine.add_word("".join([code[x] for x in passage]))
        todo = todo[rest:]
        machine.make_automaton()
        for words_, mark in zip(docs, covered, strict=True):
            for end, size in machine.iter("".join([code.get(x, "\0") for x in words_])):
                mark[end - size + 1] += 1
                mark[end + 1] -= 1
    return [np.cumsum(m[:-1]) > 0 for m in covered]


def remove_repeated(docs: DataFrame, window: int = 35, phrase: int = 8, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` for every row: the kept words
    joined by one space, or with ``digest`` their SHA-256 in lowercase hex."""
    out_of = _digest if digest else _text
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"),
                       "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column("shard").to_numpy()
            for lo, hi in blocks(b.column("text")):
                r = Runs(words(b.column("text").slice(lo, hi - lo), SPACE_WORDS), window, phrase)
                at = shard[lo + r.doc]
                order = np.lexsort((at, r.anchor))
                a, at = r.anchor[order], at[order]
                first = np.flatnonzero((np.diff(a, prepend=a[:1] + U64(1)) != 0) | (np.diff(at, prepend=-1) != 0))
                yield pa.RecordBatch.from_arrays(
                    [_signed(a[first]), pa.array(at[first]), pa.array(np.diff(np.append(first, len(a))))],
                    names=["a", "shard", "n"])

    # an anchor is one row per shard, however often it occurs there
    found = materialize(rows.select("shard", "text").mapInArrow(anchors, "a long, shard int, n long")
                        .groupBy("a", "shard").agg(F.sum("n").alias("n")), "anchors")
    twice = found.groupBy("a").agg(F.sum("n").alias("n")).where("n >= 2").select("a")
    wanted = found.join(twice, "a").select("shard", "a")

    # documents travel as compressed blocks, one per batch and shard
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = b.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            ids, blobs = [], []
            for part in np.split(order, cuts):
                if len(part):
                    ids.append(int(shard[part[0]]))
                    blobs.append(_pack(b.select(["doc_id", "text"]).take(pa.array(part))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())],
                                             names=["shard", "block"])

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.sort(right.column("a").to_numpy().view(np.uint64))
        shard = left.column("shard")[0].as_py() if left.num_rows else -1
        out, seen = [], []
        for blob in left.column("block"):
            table = _unpack(blob.as_py())
            text = table.column("text").combine_chunks()
            for lo, hi in blocks(text):
                part = text.slice(lo, hi - lo)
                r = Runs(words(part, SPACE_WORDS), window, phrase)
                hit = np.flatnonzero(_in(r.anchor, known))
                flagged = np.zeros(hi - lo, bool)
                flagged[r.doc[hit]] = True
                ids = table.column("doc_id").slice(lo, hi - lo)
                # documents without a recurring anchor are done
                plain = np.flatnonzero(~flagged)
                split = [_encode(part[int(i)].as_py()).split() for i in plain]
                n = len(plain)
                out.append(_rows(kind_of, n, kind=0, shard=shard, doc_id=ids.take(pa.array(plain)),
                                 n_words=pa.array([len(x) for x in split], pa.int64()),
                                 kept=pa.array([out_of(x) for x in split], pa.string())))
                keep = np.flatnonzero(flagged)
                if len(keep):
                    blob_ = _pack(pa.table({"doc_id": ids.take(pa.array(keep)), "text": part.take(pa.array(keep))}))
                    out.append(_rows(kind_of, 1, kind=2, shard=shard, block=pa.array([blob_], pa.binary())))
                if len(hit):
                    at, n = _distinct(r.anchor[hit], r.span[hit])
                    s, _ = r.windows(hit[at])
                    seen.append((r.anchor[hit[at]], r.span[hit[at]], n, r.size[hit[at]], r.window_hash(s)))
        if seen:                      # equal runs of the shard are one row
            a, span, n, size, w = (np.concatenate(x) for x in zip(*seen, strict=True))
            at, total = _distinct(a, span, n)
            begin = (np.cumsum(size) - size)[at]
            size = size[at]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            out.append(_rows(kind_of, len(at), kind=1, shard=shard, a=_signed(a[at]), r=_signed(span[at]),
                             n_words=pa.array(total),
                             w=pa.ListArray.from_arrays(offsets, _signed(w[np.repeat(begin, size) + inner]))))
        return pa.concat_tables(out) if out else _rows(kind_of, 0)

    kind_of = _schema(rows)
    # kind 0: a finished document; 1: a run with its windows, ``n_words`` says how often it
    # occurs in the shard; 2: a block of documents for step 3
    schema = f"kind int, shard int, doc_id {kind}, n_words long, kept string, a long, r long, " \
             "w array<long>, block binary"
    packed = rows.mapInArrow(pack, "shard int, block binary")
    state = materialize(packed.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(confirm, schema),
                        "passages")

    runs = state.where("kind = 1").select("shard", "a", "r", F.col("n_words").alias("m"), "w")
    count = runs.groupBy("a", "r").agg(F.sum("m").alias("n"))
    single = count.where("n = 1").select("a", "r")
    mixed = single.select("a").distinct()
    by_window = runs.join(mixed, "a").select("a", "m", F.explode("w").alias("w")) \
        .groupBy("a", "w").agg(F.sum("m").alias("n")).where("n >= 2").select("a", "w")
    sure = runs.select("shard", "a", "r").join(count.where("n >= 2").select("a", "r"), ["a", "r"]) \
        .select("shard", F.lit(True).alias("run"), "a", F.col("r").alias("h")).distinct()
    parts = runs.join(single, ["a", "r"]).select("shard", "a", F.explode("w").alias("w")) \
        .join(by_window, ["a", "w"]).select("shard", F.lit(False).alias("run"), "a", F.col("w").alias("h")).distinct()

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        run = right.column("run").to_numpy()
        pair = mix(right.column("a").to_numpy().view(np.uint64) * U64(3)
                   + right.column("h").to_numpy().view(np.uint64))
        known_run, known_window = np.sort(pair[run]), np.sort(pair[~run])
        ids, docs_, passages = [], [], []
        for blob in left.column("block"):
            table = _unpack(blob.as_py())
            text = table.column("text").combine_chunks()
            ids.append(table.column("doc_id").combine_chunks())
            for lo, hi in blocks(text):
                part = text.slice(lo, hi - lo)
                r = Runs(words(part, SPACE_WORDS), window, phrase)
                split = [_encode(x.as_py()).split() for x in part]
                whole = _in(mix(r.anchor * U64(3) + r.span), known_run)
                s1, _ = r.windows(np.flatnonzero(whole))
                s2, owner = r.windows(np.flatnonzero(~whole))
                s2 = s2[_in(mix(r.anchor[~whole][owner] * U64(3) + r.window_hash(s2)), known_window)]
                s = np.sort(np.concatenate([s1, s2]))
                doc = np.searchsorted(r.words.first, s, "right") - 1
                cut = np.flatnonzero((np.diff(s) != 1) | (np.diff(doc) != 0)) + 1
                for g in np.split(np.arange(len(s)), cut):
                    if len(g):
                        d = int(doc[g[0]])
                        a = int(s[g[0]] - r.words.first[d])
                        passages.append(tuple(split[d][a:a + len(g) - 1 + window]))
                docs_.extend(split)
        masks = locate(docs_, passages)
        return pa.table({
            "doc_id": pa.chunked_array(ids) if ids else pa.array([], kind_of.field("doc_id").type),
            "n_words": pa.array([len(d) for d in docs_], pa.int64()),
            "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
            "kept": pa.array([out_of([x for x, gone in zip(d, m, strict=True) if not gone])
                              for d, m in zip(docs_, masks, strict=True)], pa.string())})

    texts = state.where("kind = 2").select("shard", "block")
    known = sure.union(parts).select(F.col("shard").alias("to_shard"), "run", "a", "h")
    cut = texts.groupBy("shard").cogroup(known.groupBy("to_shard")) \
        .applyInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept string")
    plain = state.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return plain.union(cut)


def _schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema([
        ("kind", pa.int32()), ("shard", pa.int32()), ("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)),
        ("n_words", pa.int64()), ("kept", pa.string()), ("a", pa.int64()), ("r", pa.int64()),
        ("w", pa.list_(pa.int64())), ("block", pa.binary())])


def _rows(schema: pa.Schema, n: int, **columns) -> pa.Table:
    """A table of ``n`` rows: numbers are repeated, missing columns are NULL."""
    got = []
    for f in schema:
        v = columns.get(f.name)
        if v is None:
            got.append(pa.nulls(n, f.type))
        elif isinstance(v, int):
            got.append(pa.array(np.full(n, v), f.type))
        else:
            got.append(v.cast(f.type))
    return pa.Table.from_arrays(got, schema=schema)


def _pack(table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()
