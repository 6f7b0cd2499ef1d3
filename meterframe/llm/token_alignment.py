"""Alignment of two tokenizers' tokens, and how often their tokens meet.

Both tokenizers cut the same bytes (a space and the text).  Byte offsets where
tokens of both end cut the text into groups; a token of A and one of B are
linked where their byte ranges overlap.  Every stretch between neighbouring
ends of either tokenizer belongs to exactly one token of each, so the links are
the merged ends.

Both tokenizers begin a new token at a single space between two characters that
are no white space, and never look across it.  Such a space therefore begins a
new group, and the stretch from one to the next, a unit (mostly a word),
is aligned once and remembered by the worker.  Where the vocabulary files do
not promise that (:meth:`Tokenizers.units`), the whole text is one unit.

Counts of linked id pairs over the whole corpus:

1. a first pass aligns all documents and leaves, per block of texts, the
   distinct pairs with their number of links;
2. the distinct pairs get a minimal perfect hash, built group by group;
3. tasks turn the blocks' numbers into dense vectors indexed by that hash, and
   the vectors are summed in a tree, a few at a time and segment by segment;
4. a second pass aligns the documents again and looks every link up; keys stand
   in their slots, so a pair that is not in the table at hand is known as such.

The table at hand has at most ``at_once`` pairs.  If the corpus has more, the
hash groups are taken in rounds: step 3 runs once per round, and step 4 adds
up over the rounds, so tasks never hold more than one table of that size.

Defined results: a text that is NULL, empty, or whose tokens do not join to
its bytes (for instance with the vocabulary's own space mark in it) has no
tokens, zeros and an empty ``groups``; special tokens inside texts are plain
text; repeated rows repeat their result and count each time; texts of any
length are aligned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pair_hash
from .frames import free_name, materialize
from .pair_hash import PairHash

_BLOCK = 1 << 19           # characters of text aligned together
_UNITS = 1 << 17           # units that a worker remembers, about
_SEGMENT = 1 << 15         # slots per row of a dense vector


@dataclass(frozen=True)
class Vocabularies:
    """Paths of the two vocabulary files (None: the public ones)."""
    a: str | None = None
    b: str | None = None


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, paths: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"             # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        a, b = paths.a, paths.b
        if a is None or b is None:
            import public_tokenizers
            a = a or public_tokenizers.path("byte_bpe_50k.json")
            b = b or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = _byte_letters()
        n = 1 + max(self.a.get_vocab(with_added_tokens=True).values(), default=0)
        self.bytes_a = [bytes(map(byte.__getitem__, t)) if (t := self.a.id_to_token(i)) and all(c in byte for c in t)
                        else (t or "").encode() for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64, n)
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self._joined_a, self._joined_b = pa.array(self.bytes_a, pa.binary()), pa.array(self.bytes_b, pa.binary())
        # written ids: A's before another A or before the bar, B's before another B or before the end of a group
        self.written = pa.array([f"{i}{c}" for c in ",|" for i in range(n)] +
                                [f"{i}{c}" for c in ",;" for i in range(len(self.bytes_b))])
        self.written_length = np.fromiter(map(len, self.written.to_pylist()), np.int64, len(self.written))
        rules = json.loads(self.a.to_str())
        self._quick = _ranked(rules, byte)
        cut, none = rules.get("pre_tokenizer") or {}, rules.get("normalizer") is None
        self._cuts = none and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex", True)) \
            and not any("▁" in p.lstrip("▁") for p in self.b.id_to_piece(list(range(self.b.get_piece_size()))))

    def units(self, text: str) -> list[str]:
        """The text cut at spaces where both tokenizers begin anew: A splits
        there before it merges anything, and none of B's pieces has a space
        mark behind another character."""
        if not text:
            return []
        return _CUT(text) if self._cuts else [text]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B, unit after unit, and each unit's first place in them
        (with the total); no ids where the tokens do not join to the bytes.

        Units without white space at either end are encoded as one text, which
        would be cut into just these units; the others one by one."""
        if self._cuts and len(units) > 1 and not any(u[0].isspace() or u[-1].isspace() for u in units):
            joined = " " + " ".join(units)
            text = joined.encode()
            quick = self._quick is not None and (joined.isascii() or max(joined) < _LATIN)
            a = np.array(self._quick.encode_ordinary(joined) if quick else
                         self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            ids_b = self.b.encode(units, num_threads=1)
            b = _flat(ids_b)
            if _joined(self._joined_a, a) == _joined(self._joined_b, b) == text:
                end = np.cumsum(np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)) + 1)
                return a, b, np.append(0, np.searchsorted(np.cumsum(self.length_a[a]), end, "right")), _firsts(ids_b)
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        for i, u in enumerate(units):
            want = (" " + u).encode()
            if not want == b"".join(map(self.bytes_a.__getitem__, ids_a[i])) == b"".join(map(self.bytes_b.__getitem__, ids_b[i])):
                ids_a[i], ids_b[i] = [], []
        return *map(_flat, (ids_a, ids_b)), *map(_firsts, (ids_a, ids_b))


#: Characters below this one are in the same classes in every version of Unicode since 5.0.
_LATIN = "\u0250"
#: Fixed value: how byte-level vocabularies cut texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(rules: dict, byte: dict[str, int]):
    """A's vocabulary for the faster of the two libraries that apply byte pair
    merges by rank; None unless every merge makes the next id."""
    import tiktoken
    model = rules["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    special = {t["content"] for t in rules.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special} if isinstance(model["vocab"], dict) else {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
    return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r"(?<=\S) (?=\S)").split


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))


def _firsts(ids: list[list[int]]) -> np.ndarray:
    return np.cumsum([0, *map(len, ids)])


def _joined(strings: pa.Array, at: np.ndarray) -> bytes:
    """The strings at ``at``, joined."""
    taken = strings.take(pa.array(at)).buffers()
    size = int(np.frombuffer(taken[1], np.int32)[len(at)]) if len(at) else 0
    return taken[2].to_pybytes()[:size] if size else b""


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_tokenizers: dict[Vocabularies, Tokenizers] = {}


def _of(paths: Vocabularies) -> Tokenizers:
    """Kept by the worker from task to task (two vocabularies, no texts)."""
    if paths not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[paths] = Tokenizers(paths)
    return _tokenizers[paths]


@dataclass
class Aligned:
    """Aligned units: tokens and links one after another."""
    a: np.ndarray              # ids of A's tokens
    b: np.ndarray
    end_a: np.ndarray          # offset behind each of A's tokens, over all units
    end_b: np.ndarray
    first_a: np.ndarray        # first token of each unit, and the total
    first_b: np.ndarray
    link_a: np.ndarray         # token of A in each link
    link_b: np.ndarray
    end: np.ndarray            # offset behind each link's stretch

    def pairs(self, n_b: int) -> np.ndarray:
        return self.a[self.link_a].astype(np.int64) * n_b + self.b[self.link_b]


def align(tokens: Tokenizers, units: list[str]) -> Aligned:
    a, b, first_a, first_b = tokens.encode(units)
    end_a, end_b = np.cumsum(tokens.length_a[a]), np.cumsum(tokens.length_b[b])
    # merged ends; a token of no bytes ends where the one before does and overlaps nothing
    end = np.concatenate([end_a, end_b])
    end.sort(kind="stable")
    end = end[np.diff(end, prepend=0) > 0]
    return Aligned(a, b, end_a, end_b, first_a, first_b,
                   np.searchsorted(end_a, end), np.searchsorted(end_b, end), end)


def written_groups(tokens: Tokenizers, got: Aligned) -> tuple[list[str], np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of every unit, and its number of groups."""
    both = got.end_a[np.searchsorted(got.end_b, got.end_a, "right") > np.searchsorted(got.end_b, got.end_a, "left")]
    both = both[np.diff(both, prepend=0) > 0]                          # ends of groups
    group_a, group_b = np.searchsorted(both, got.end_a), np.searchsorted(both, got.end_b)
    last_a = np.diff(group_a, append=-1) != 0
    last_b = np.diff(group_b, append=-1) != 0
    n_a, n_b = len(tokens.bytes_a), len(tokens.bytes_b)
    code = np.concatenate([got.a + n_a * last_a, 2 * n_a + got.b + n_b * last_b])
    # a group's tokens of A, then those of B
    at_a = np.arange(len(got.a)) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(len(got.b)) + np.searchsorted(group_a, group_b, "right")
    order = np.empty(len(code), np.int64)
    order[np.concatenate([at_a, at_b])] = code
    cut = got.first_a + got.first_b
    joined = _joined(tokens.written, order).decode()
    place = np.append(0, np.cumsum(tokens.written_length[order]))[cut]
    out = [joined[lo:max(lo, hi - 1)] for lo, hi in zip(place.tolist(), place[1:].tolist(), strict=False)]
    begin = np.append(0, got.end_a)[got.first_a]
    return out, np.diff(np.searchsorted(both, begin, "right"))


class Units:
    """Units by number, with their alignment; remembers what it has seen.  When
    there are too many, those that stood in one block only go, or all if
    that does not help."""

    def __init__(self, tokens: Tokenizers, written: bool):
        self.tokens, self.keep_written = tokens, written
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.n = np.zeros((0, 4), np.int64)               # tokens of A, of B, groups, links
        self.first = np.zeros(1, np.int64)                # first link of each unit, and the total
        self.pairs = np.zeros(0, np.int64)                # pairs of the links, unit after unit
        self.written: list[str] = []
        self.blocks = np.zeros(0, np.int32)               # blocks that had the unit
        self.cleared = getattr(self, "cleared", 0) + 1

    def _forget(self) -> None:
        place, n, blocks, written = self.place, self.n, self.blocks, self.written
        keep = np.flatnonzero(blocks > 1)
        pairs = self.pairs[self.links(keep)]
        self._clear()
        if 2 * len(keep) < len(n):
            name = list(place)                            # numbers follow the order of learning
            self.place = {name[k]: i for i, k in enumerate(keep.tolist())}
            self.n, self.pairs, self.blocks = n[keep], pairs, np.zeros(len(keep), np.int32)
            self.first = np.append(0, np.cumsum(self.n[:, 3]))
            self.written = [written[k] for k in keep.tolist()] if written else []

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of the texts, text after text, and the first
        one of each text (with the total).  A text with a unit that does not
        join to its bytes has none."""
        if len(self.place) > _UNITS:
            self._forget()
        cut = [self.tokens.units(t) for t in texts]
        place = self.place
        new = [u for u in set(chain.from_iterable(cut)) if u not in place]
        if new:
            self._learn(new)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        self.blocks[at] += 1
        first = _firsts(cut)
        bad = np.flatnonzero(self.n[at, 0] == 0)
        if len(bad):
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            stay = ~np.isin(text, text[bad])
            at, first = at[stay], np.append(0, np.cumsum(np.bincount(text[stay], minlength=len(texts))))
        return at, first

    def _learn(self, new: list[str]) -> None:
        odd = [u for u in new if "▁" in u or not u.strip() == u]
        if odd and len(odd) < len(new):
            self._learn(odd)
            new = [u for u in new if u not in self.place]
        got = align(self.tokens, new)
        groups, n_groups = written_groups(self.tokens, got)
        self.place.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
        begin = np.append(0, got.end_a)[got.first_a]
        n_links = np.diff(np.searchsorted(got.end, begin, "right"))     # links that end behind the unit's beginning
        n = np.stack([np.diff(got.first_a), np.diff(got.first_b), n_groups, n_links], axis=1)
        self.n = np.concatenate([self.n, n])
        self.blocks = np.append(self.blocks, np.zeros(len(new), np.int32))
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n_links))
        self.pairs = np.concatenate([self.pairs, got.pairs(len(self.tokens.bytes_b))])
        if self.keep_written:
            self.written += groups

    def links(self, units: np.ndarray) -> np.ndarray:
        """Places in ``pairs`` of the links of some units, unit after unit."""
        n = self.n[units, 3]
        return np.repeat(self.first[units] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of about ``_BLOCK`` characters (at least one text)."""
    values = [t or "" for t in texts.to_pylist()]
    lo, size = 0, 0
    for i, t in enumerate(values):
        size += len(t)
        if size >= _BLOCK or i + 1 == len(values):
            yield lo, i + 1, values[lo:i + 1]
            lo, size = i + 1, 0


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return np.diff(total[first], axis=0)


def block_pairs(docs: DataFrame, paths: Vocabularies) -> DataFrame:
    """(pair, n): links of each distinct pair of a block of texts; a pair is
    A's id times the size of B's vocabulary plus B's id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_of(paths), False)
        for batch in batches:
            for _, _, texts in _blocks(batch.column("text")):
                unit, n = np.unique(units.block(texts)[0], return_counts=True)
                links = np.repeat(n, units.n[unit, 3])
                pair, at = np.unique(units.pairs[units.links(unit)], return_inverse=True)
                n = np.bincount(at, weights=links, minlength=len(pair)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long")


def hash_groups(pairs: DataFrame, n_groups: int) -> DataFrame:
    """(grp, sizes, placed): levels of the hash of every group of pairs."""
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = pair_hash.group_of(b.column("pair").to_numpy(), n_groups)
            yield pa.RecordBatch.from_arrays([pa.array(g), b.column("pair")], names=["grp", "pair"])

    def build(table: pa.Table) -> pa.Table:
        sizes, placed = pair_hash.build(np.sort(table.column("pair").to_numpy()))
        return pa.table({"grp": table.column("grp").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "placed": pa.array([[k.tobytes() for k in placed]], pa.list_(pa.binary()))})

    return pairs.mapInArrow(group, "grp long, pair long").groupBy("grp") \
        .applyInArrow(build, "grp long, sizes array<long>, placed array<binary>")


def _hash_of(built: DataFrame, first: int, last: int) -> PairHash:
    """The hash over groups ``first`` .. ``last`` - 1.  A bounded number of pairs."""
    rows = {r.grp: r for r in built.where((F.col("grp") >= first) & (F.col("grp") < last)).toLocalIterator()}
    return PairHash.of([(list(rows[g].sizes), [np.frombuffer(k, np.int64) for k in rows[g].placed])
                        if g in rows else ([], []) for g in range(first, last)])


def dense_counts(blocks: DataFrame, table: PairHash, n_groups: int, first: int, n_vectors: int,
                 fan_in: int = 8) -> DataFrame:
    """(segment, node, counts): links by slot, in segments; dense vectors of
    the tasks, summed in a tree."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(table)               # of bounded size
    schema = "segment int, node int, counts binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, node = shared.value, None
        total = np.zeros(len(known.keys), np.int64)
        for b in batches:
            pair, n = b.column("pair").to_numpy(), b.column("n").to_numpy()
            node = b.column("node")[0].as_py() if node is None and b.num_rows else node
            group = pair_hash.group_of(pair, n_groups) - first
            here = np.flatnonzero((group >= 0) & (group < len(known.sizes)))
            slot = known.slots(pair[here], group[here])
            np.add.at(total, slot[slot >= 0], n[here][slot >= 0])
        for s in range(0, len(total) if node is not None else 0, _SEGMENT):
            part = total[s:s + _SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s // _SEGMENT], pa.int32()), pa.array([node], pa.int32()), pa.array([part.tobytes()])],
                    names=["segment", "node", "counts"])

    def join(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")], axis=0)
        return pa.table({"segment": table.column("segment").slice(0, 1),
                         "node": pa.array([table.column("node")[0].as_py()], pa.int32()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    dealt = blocks.repartition(n_vectors, F.pmod(F.xxhash64("pair", "n"), F.lit(n_vectors)))
    vectors = dealt.select("pair", "n", F.spark_partition_id().alias("node")).mapInArrow(add, schema)
    left = n_vectors
    while left > 1:
        left = -(-left // fan_in)
        vectors = vectors.withColumn("node", F.col("node") % left).groupBy("segment", "node").applyInArrow(join, schema)
    out = materialize(vectors, "pair-counts")
    shared.unpersist()
    return out


def _counts_of(segments: DataFrame, size: int) -> np.ndarray:
    """The summed vector of one round.  A bounded number of pairs."""
    out = np.zeros(size, np.int64)
    for r in segments.toLocalIterator():
        part = np.frombuffer(r.counts, np.int64)
        out[r.segment * _SEGMENT:r.segment * _SEGMENT + len(part)] += part
    return out


def _looked_up(docs: DataFrame, paths: Vocabularies, name: str, table: PairHash, counts: np.ndarray, best: np.ndarray,
               n_groups: int, first: int, start: bool) -> DataFrame:
    """One round of the second pass: ``name`` gets the sums over the links
    whose pairs are in the table; the first round writes the rest of it."""
    shared = docs.sparkSession.sparkContext.broadcast((table, counts, best))       # of bounded size
    kind = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_best:bigint,count_sum:bigint,groups:string>"
    schema = docs.withColumn(name, F.lit(None).cast(kind)).schema

    def sums(units: Units, known: list) -> np.ndarray:
        """(best links, sum of counts) of every unit; ``known`` holds those of
        the units known before, and since which clearing."""
        table, count, top = shared.value
        if known[1] != units.cleared:
            known[:] = [np.zeros((0, 2), np.int64), units.cleared]
        lo = len(known[0])
        pair = units.pairs[units.first[lo]:]
        group = pair_hash.group_of(pair, n_groups) - first
        here = np.flatnonzero((group >= 0) & (group < len(table.sizes)))
        slot = np.full(len(pair), -1, np.int64)
        slot[here] = table.slots(pair[here], group[here])
        found = np.where(slot >= 0, count[slot] if len(count) else 0, 0)
        is_best = (slot >= 0) & (found == top[pair % len(top)])
        new = _by_text(np.stack([is_best, found], axis=1).astype(np.int64), units.first[lo:] - units.first[lo])
        known[0] = np.concatenate([known[0], new])
        return known[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, known = Units(_of(paths), start), [None, 0]
        fields = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        for batch in batches:
            for lo, hi, texts in _blocks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                at, begin = units.block(texts)
                best = _by_text(sums(units, known)[at], begin)
                if start:
                    n, write = _by_text(units.n[at], begin), units.written.__getitem__
                    numbers, cut = at.tolist(), begin.tolist()
                    groups = [";".join(map(write, numbers[i:j])) for i, j in zip(cut, cut[1:], strict=False)]
                    cols = [*n.T, *best.T, groups]
                else:
                    old = part.column(name)
                    cols = [old.field(i) for i in range(7)]
                    cols[4], cols[5] = cols[4].to_numpy() + best[:, 0], cols[5].to_numpy() + best[:, 1]
                new = pa.StructArray.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, pa.string() if f == "groups" else pa.int64())
                     for f, c in zip(fields, cols, strict=True)], names=fields)
                kept = [c for c in part.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], new], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def alignment(docs: DataFrame, paths: Vocabularies = Vocabularies(), at_once: int = 1 << 21,
              group: int = 1 << 14) -> DataFrame:
    """``docs`` with a struct column ``alignment`` appended (n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups); if the name is taken, underscores
    are added."""
    name = free_name(docs, "alignment")
    n_b = len(_of(paths).bytes_b)
    blocks = materialize(block_pairs(docs, paths), "token-pairs")
    pairs = materialize(blocks.select("pair").distinct(), "distinct-pairs")
    n_pairs, n_rows = pairs.count(), blocks.count()
    n_groups = max(1, -(-n_pairs // group))
    built = materialize(hash_groups(pairs, n_groups), "pair-hash")
    per_round = max(1, at_once // group)
    # vectors as dense as the rows they sum: no more of them than rows for each slot
    n_vectors = max(1, n_rows // max(1, min(n_pairs, at_once)))
    best = np.zeros(n_b, np.int64)
    rounds: list[tuple[int, int, DataFrame]] = []
    for first in range(0, n_groups, per_round):
        last = min(n_groups, first + per_round)
        table = _hash_of(built, first, last)
        segments = dense_counts(blocks, table, n_groups, first, n_vectors)
        np.maximum.at(best, table.keys % n_b, _counts_of(segments, len(table.keys)))
        rounds.append((first, last, segments))
    out = docs
    for i, (first, last, segments) in enumerate(rounds):
        table = _hash_of(built, first, last)
        out = _looked_up(out, paths, name, table, _counts_of(segments, len(table.keys)), best, n_groups, first, i == 0)
        if i + 1 < len(rounds):
            out = materialize(out, "alignment")
    return out
