"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all values within *half* the radius of it.
Two fingerprints within the radius share such a value, so one shuffle on the
emitted values brings every linked pair together.  Because two members of a
bucket are each within half the radius of its value, all members of a bucket
are linked; consecutive members (sorted) are enough to connect them, and each
such pair is verified by its bit count.  Connected components are found by
alternating star contractions, each round written to the shared folder.

Work is linear in the number of distinct fingerprints: copies meet in one
partial aggregate before anything is emitted, a bucket holds at most as many
fingerprints as a ball has points, and no pair list is ever expanded.

Defined results: a text without words has fingerprint zero and is linked like
any other; repeated rows share fingerprint and class; the class id is the
smallest ``doc_id`` of the class (NULL ids are ignored unless all are NULL).
Texts of
any length are fingerprinted whole; an empty table gives an empty result; further
columns, whatever their names, are kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import key_of, materialize, row_key, text_hash

BITS = 64
_BLOCK = 1 << 15


def _fingerprint(text: str | None, shingle: int, seed: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII case and space only
    if not words:
        return 0
    parts = words if shingle == 1 else None
    if len(words) < shingle:
        parts = [b" ".join(words)]
    n = len(parts) if parts is not None else len(words) - shingle + 1
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, n, _BLOCK):                                         # bounded memory for long texts
        hi = min(n, lo + _BLOCK)
        block = parts[lo:hi] if parts is not None else map(
            b" ".join, zip(*(words[lo + k:hi + k] for k in range(shingle)), strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in block), np.uint64, hi - lo)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fp, pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def ball(half: int) -> list[int]:
    """All XOR masks of at most ``half`` bits, as signed 64-bit values."""
    out = []
    for k in range(half + 1):
        for bits in combinations(range(BITS), k):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << BITS) if m >= 1 << (BITS - 1) else m)
    return out


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): verified pairs of distinct fingerprints that connect every pair
    within ``radius`` (an even number)."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is emitted on either side")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = distinct.select("fp", F.explode(masks).alias("m")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("before")).where(F.col("before").isNotNull()) \
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius)
    return pairs.select(F.col("before").alias("u"), F.col("fp").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; the root is the smallest node.

    Alternating star contractions: each node's larger neighbours move to the
    smallest one around it, then its smaller neighbours do, until all edges
    are stars.  The number of rounds is logarithmic in practice; neighbours of
    a hub are never gathered (minimum by partial aggregate, then a join that
    adaptive execution can split)."""
    e = materialize(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
                    .where("a <> b").distinct(), "cc")
    seen = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")) \
                .union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")) \
            .union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = materialize(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "cc")


def classes(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id, keep_id, keep_hash) for every distinct fingerprint of
    ``rows`` (doc_id, text_hash, fp); the last two name the row to keep."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    each = materialize(rows.groupBy("fp").agg(first.alias("first")), "fp")
    roots = components(links(each.select("fp"), radius))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(best, "root").select(
        "fp", F.col("best.doc_id").alias("component_id"), F.col("best.doc_id").alias("keep_id"),
        F.col("best.text_hash").alias("keep_hash"))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, component_id, keep_id, keep_hash."""
    rows = materialize(fingerprints(docs, shingle, seed), "simhash")
    return rows.join(classes(rows, radius), "fp")


def deduplicate(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """``docs`` with one row left of every class (all columns kept).

    The row with the smallest (doc_id, text hash) stays; of rows equal in both,
    one stays."""
    keys = near_duplicates(docs, shingle, seed, radius)
    stay = keys.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))) \
        .select(key_of("doc_id", "text_hash").alias("k")).distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("k")) \
        .join(stay, "k", "left_semi")
    one = F.row_number().over(Window.partitionBy("k").orderBy(F.lit(0)))
    return d.withColumn("n", one).where("n = 1").select("row.*")
