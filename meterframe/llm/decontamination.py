"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows (13 consecutive words; a shorter
item is one window).  A window is contained in a document if all its shingles
(5 consecutive words; fewer for shorter windows) occur there in line.  For
containment the join needs only one shingle of each window, and the rarest
one gives the fewest candidates:

1. one scan of the documents counts every benchmark shingle in the corpus;
2. the shingles are ordered by that count, and each window keeps its rarest
   one with its position (the *prefix*);
3. a second scan emits a candidate wherever a document has a prefix shingle,
   with the words around it: at most a window to either side;
4. candidates are joined with the prefixes on the shingle, cut by length and
   position (the window must lie inside the document), and every survivor is
   verified word by word.

In both scans a bitmap of fixed size lets only shingles through that the
benchmark may have, so documents are never shuffled; what passes it wrongly
falls in the join.  The bitmap is the only thing sent to all tasks.

Defined results: NULL and empty texts have no words and no hits; an item
without words has no window; equal windows of several items count for each;
repeated rows are counted once each in the result.
Texts of any length are
read whole; empty tables give empty results or leave every document; further
columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialize, row_key
from .lexer import ALNUM_WORDS, U64, blocks, phrase_hash, words

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the shingle filter: 2**BITS / 8 bytes (1 MB) reach every task, whatever the benchmark's size.
FILTER_BITS = 23


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word shingle, k included (shingles of different length differ)."""
    return phrase_hash(h, k) ^ U64(k)


def item_windows(items: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """(item_id, words, offset, k, shingle): every shingle of every window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column("text"), ALNUM_WORDS, lower=True)
            ids, at, off, ks, hs, texts = [], [], [], [], [], []
            for d in range(w.n_docs):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                if lo == hi:
                    continue
                size = min(window, hi - lo)
                k = min(shingle, size)
                sh = _shingles(w.hash[lo:hi], k)
                strings = [w.data[w.start[i]:w.end[i]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
                for s in range(hi - lo - size + 1):
                    for o in range(size - k + 1):
                        ids.append(b.column("item_id")[d].as_py())
                        at.append(s)
                        off.append(o)
                        ks.append(k)
                        hs.append(int(sh[s + o].astype(np.int64)))
                        texts.append(" ".join(strings[s:s + size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field("item_id").type), pa.array(texts, pa.string()),
                 pa.array(off, pa.int32()), pa.array(ks, pa.int32()), pa.array(hs, pa.int64())],
                names=["item_id", "words", "offset", "k", "shingle"])

    src = items.select("item_id", "text")
    kind = src.schema["item_id"].dataType.simpleString()
    return src.mapInArrow(run, f"item_id {kind}, words string, offset int, k int, shingle long")


def _filter(shingles: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bitmap of the shingles and the shingle lengths that occur.  What reaches
    the driver is bounded by the bitmap: at most 2**FILTER_BITS slots."""
    slots = shingles.select(F.shiftrightunsigned("shingle", 64 - FILTER_BITS).cast("int").alias("s")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    got = slots.toArrow().column("s").to_numpy()
    bits[got] = True
    ks = sorted(r[0] for r in shingles.select("k").distinct().collect())    # at most `shingle` values
    return np.packbits(bits), ks


def _passing(h: np.ndarray, k: int, first: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose k-word shingle lies in one document and passes the filter."""
    sh = _shingles(h, k)
    slot = sh >> U64(64 - FILTER_BITS)
    ok = (bitmap[(slot >> U64(3)).astype(np.int64)] >> (7 - (slot & U64(7)).astype(np.uint8))) & 1
    pos = np.flatnonzero(ok)
    doc = np.searchsorted(first, pos, "right") - 1
    inside = pos + k <= first[doc + 1]
    return pos[inside], sh[pos[inside]]


def shingle_counts(docs: DataFrame, bitmap, ks: list[int]) -> DataFrame:
    """(k, shingle, n): how often shingles passing the filter occur in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            col = b.column("text")
            for lo, hi in blocks(col):
                w = words(col.slice(lo, hi - lo), ALNUM_WORDS, lower=True)
                for k in ks:
                    _, sh = _passing(w.hash, k, w.first, bits)
                    u, n = np.unique(sh.astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(u), k, np.int32)), pa.array(u), pa.array(n.astype(np.int64))],
                        names=["k", "shingle", "n"])

    return docs.select("text").mapInArrow(run, "k int, shingle long, n long") \
        .groupBy("k", "shingle").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, bitmap, ks: list[int], window: int) -> DataFrame:
    """(key, pos, k, shingle, before, context): places of filter-passing
    shingles with up to a window of words to either side; ``before`` words of
    the context precede the shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            col = b.column("text")
            for lo, hi in blocks(col):
                w = words(col.slice(lo, hi - lo), ALNUM_WORDS, lower=True)
                for k in ks:
                    pos, sh = _passing(w.hash, k, w.first, bits)
                    if not len(pos):
                        continue
                    doc = np.searchsorted(w.first, pos, "right") - 1
                    left = np.maximum(pos - (window - k), w.first[doc])
                    right = np.minimum(pos + window, w.first[doc + 1])
                    text = [" ".join(w.data[s:e].tobytes().decode("utf-8", "replace")
                                     for s, e in zip(w.start[i:j], w.end[i:j], strict=True))
                            for i, j in zip(left, right, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("key").take(pa.array(doc + lo)), pa.array(pos - w.first[doc]),
                         pa.array(np.full(len(pos), k, np.int32)), pa.array(sh.astype(np.int64)),
                         pa.array((pos - left).astype(np.int32)), pa.array(text, pa.string())],
                        names=["key", "pos", "k", "shingle", "before", "context"])

    return docs.select(row_key().alias("key"), "text").mapInArrow(
        run, "key string, pos long, k int, shingle long, before int, context string")


def occurrences(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences (key, start, len, words) of benchmark windows in
    the documents, and the windows of each item (item_id, words)."""
    sc = docs.sparkSession.sparkContext
    grams = materialize(item_windows(items, window, shingle), "item-shingles")
    bits, ks = _filter(grams)
    # 2: rarity over the whole corpus; ties go to the smaller hash, so overlapping windows tend to share a prefix
    seen = shingle_counts(docs, sc.broadcast(bits), ks)
    texts = grams.select("words", "offset", "k", "shingle").distinct()
    ranked = texts.join(seen, ["k", "shingle"], "left").select(
        "words", "offset", "k", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = ranked.groupBy("words").agg(F.min(F.struct("n", "shingle", "offset", "k")).alias("p")) \
        .where("p.n > 0").select("words", "p.shingle", "p.offset", "p.k")
    prefix = materialize(prefix.withColumn("size", F.size(F.split("words", " "))), "prefix")
    bits, ks = _filter(prefix)
    found = candidates(docs, sc.broadcast(bits), ks, window).join(prefix, ["k", "shingle"])
    # length and position: the window starts inside the context and ends inside it
    found = found.where("offset <= before and pos >= offset")
    around = F.split("context", " ")
    same = F.slice(around, F.col("before") - F.col("offset") + 1, F.col("size")) == F.split("words", " ")
    return found.where(same).select("key", (F.col("pos") - F.col("offset")).alias("start"),
                                    F.col("size").alias("len"), "words"), \
        grams.select("item_id", "words").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """(key, n_hit, items): documents with at least one occurrence: the words
    inside occurrences (each counted once) and the distinct items, sorted as
    strings."""
    occ, by_item = occurrences(docs, items, window, shingle)
    occ = materialize(occ, "occurrences")
    spans = occ.select("key", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("key").orderBy("start", "end")
                               .rowsBetween(Window.unboundedPreceding, -1))
    hits = spans.withColumn("done", F.coalesce(before, F.lit(0))) \
        .groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit"))
    named = occ.select("key", "words").distinct().join(by_item, "words").select("key", "item_id").distinct()
    names = named.groupBy("key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return hits.join(names, "key")


def word_count(docs: DataFrame) -> DataFrame:
    """doc_id, key and n_words of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("text")
            n = [words(col.slice(lo, hi - lo), ALNUM_WORDS, lower=True).counts() for lo, hi in blocks(col)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))],
                names=["doc_id", "key", "n_words"])

    src = docs.select("doc_id", row_key().alias("key"), "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, key string, n_words long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """``docs`` without contaminated rows: a twentieth or more of the words hit."""
    bad = word_count(docs).join(contamination(docs, items, window, shingle), "key") \
        .where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("key").alias("k")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("k"))
    return rows.join(bad, "k", "left_anti").select("row.*")
