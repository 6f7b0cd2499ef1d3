"""SentencePiece encoding and decoding with the N best segmentations.

The pieces and scores of a SentencePiece model file span a lattice over the
text (spaces become the mark ``▁``, one more is put in front).  A segmentation
scores the sum of its pieces.  A forward Viterbi pass gives the best score
from the beginning to every place; backward A-star search from the end then
uses these scores as its heuristic.  They are exact, so the search takes paths
off its queue in order of their total score, and the first N complete ones are
the N best.

Where no piece contains two neighbouring characters, every segmentation has a
border, so the lattice falls apart there.  A text is searched part by part,
and the N best of the text are put together from the N best of its words:
another segmentation among the N best deviates only in words whose second best
segmentation loses least.  That loss follows from Viterbi scores in both
directions (the best path over any piece that the best segmentation does not
use), so only the words with the smallest losses are searched.

Best segmentations and losses of new words are found for whole blocks of words
at once, place by place in all words of a block.  Texts are taken apart and put
together as arrays, a slice of the column at a time.  Workers remember words,
and the searches of words, in memory of fixed size (``_WORD_BYTES``), those used
most for the longest time; what is remembered changes no result.

A character that is no piece (and a mark that is in the text itself) is
written as the model's byte pieces, at a penalty below every score, so that
decoding an encoding always gives the text back.

Ties are resolved by the order of the queue, which depends on the part alone,
so results do not depend on partitioning.

Defined results: NULL and empty texts have the empty encoding with score 0;
repeated rows repeat their result; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import free_name
from .lexer import buffers
from .piece_lattice import MARK, PieceGrid, Pieces, blocks

_WORD_BYTES = 32 << 20     # memory for words that a worker remembers, about
_SLICE = 1 << 19           # bytes of text, or of ids, worked on together


#: Stands for a mark in the text itself; a lone surrogate cannot occur in UTF-8.
_OWN_MARK = "\ud800"


class Lattice:
    """The pieces of a model: id and score by string."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """``pieces``: string, score and kind (normal, byte or other) by id."""
        self.piece = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.score = {p: s for p, s, kind in pieces if kind == "normal"}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.raw = _raw(pieces)
        self.longest = max(map(len, self.piece), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.joined = {p[i:i + 2] for p in self.piece for i in range(len(p) - 1)}
        normal = [(p, i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        self.known = Pieces([p for p, _, _ in normal])
        self.id_of = np.array([0, *(i for _, i, _ in normal)], np.int64)          # by the number of the piece, 0: unknown
        self.scores = np.array([self.unknown, *(s for _, _, s in normal)])
        # score by prefix of a piece (None: no piece itself): a range that is none cannot grow into a piece
        self.grow: dict[str, float | None] = {p[:i]: None for p in self.piece for i in range(1, len(p) + 1)} | self.score
        # if no piece has a mark after another character, every mark begins a part
        self.marks_begin = all(x[0] == MARK for x in self.joined if x[1] == MARK)

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of texts, a space put in front of each text, cut before
        runs of spaces where that is exact; the first one of each text, and the
        total at the end."""
        data, offsets = buffers(texts)
        begin = offsets[:-1][np.diff(offsets) > 0]
        data = np.insert(data, begin, 0x20)
        begin = begin + np.arange(len(begin))
        offsets = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
        if self.marks_begin:
            cut = data == 0x20
            cut[1:] &= data[:-1] != 0x20
            cut[begin] = True
            begin = np.flatnonzero(cut)
        words = pa.LargeStringArray.from_buffers(
            len(begin), pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data))
        return words.dictionary_encode(), np.searchsorted(begin, offsets)

    def parts(self, text: str) -> list[str]:
        """The text cut between characters that no piece joins."""
        joined, out, begin = self.joined, [], 0
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in joined:
                out.append(text[begin:i])
                begin = i
        out.append(text[begin:])
        return out

    def ids(self, piece: str) -> tuple[int, ...]:
        got = self.piece.get(piece)
        if got is not None:
            return (got,)
        return tuple([self.byte[b] for b in piece.replace(_OWN_MARK, MARK).encode()])

    def forward(self, part: str) -> tuple[list[list[tuple[int, float, float]]], list[float]]:
        """(start, score, best score up to the start) of the pieces that end at
        each place, and the best score up to each place."""
        size, grow, longest = len(part), self.grow, self.longest
        arrive: list[list[tuple[int, float, float]]] = [[] for _ in range(size + 1)]
        best = [0.0] * (size + 1)
        here = 0.0
        for i in range(size):
            if i:
                best[i] = here = max([s + b for _, s, b in arrive[i]])
            s = grow.get(part[i])
            arrive[i + 1].append((i, self.unknown if s is None else s, here))
            for j in range(i + 2, min(size, i + longest) + 1):
                p = part[i:j]
                if p not in grow:
                    break
                s = grow[p]
                if s is not None:
                    arrive[j].append((i, s, here))
        best[size] = max([s + b for _, s, b in arrive[size]])
        return arrive, best

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word (as texts have it) the score of its best segmentation, what the second best
        loses (infinite if there is none), and where the best one's ids begin
        and how many they are in the last array."""
        score, loss = np.zeros(len(words)), np.zeros(len(words))
        begin, size, ids, done = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0
        for part in blocks(words):
            score[part], loss[part], size[part], got = self._best_of([words[i] for i in part.tolist()])
            begin[part] = done + np.cumsum(size[part]) - size[part]
            done += len(got)
            ids.append(got)
        return score, loss, begin, size, np.concatenate(ids)

    def _best_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, size = _form(" ".join(words) + " "), np.fromiter(map(len, words), np.int64, len(words))
        grid = PieceGrid(text, size, self.known)
        at, reach = grid.at.tolist(), grid.reach.tolist()
        s = np.full(grid.number.shape, -np.inf)                                       # score of the piece of each length at a place
        for n, (start, number) in enumerate(grid.found):
            s[n, start] = self.scores[number]
        ahead, come = np.full(s.shape[1], -np.inf), np.zeros(s.shape[1], np.int64)    # best score up to a place, and its last piece's length
        ahead[:len(words)] = 0
        for p, n in grid.steps:
            k = reach[p + n]
            x, top = ahead[at[p]:at[p] + k] + s[n - 1, at[p]:at[p] + k], ahead[at[p + n]:at[p + n] + k]
            better = x >= top                                                         # of equal ones, the shortest piece
            np.copyto(top, x, where=better)
            np.copyto(come[at[p + n]:at[p + n] + k], n, where=better)
        word, step = np.arange(len(words)), size
        path = []
        while len(word):
            n = come[grid.at[step] + word]
            step = step - n
            path.append((word, step, n))
            word, step = word[step > 0], step[step > 0]
        word, step, n = (np.concatenate(x) for x in zip(*path, strict=True))
        used = (n - 1, grid.at[step] + word)
        other = s.copy()                                                              # of pieces that the best path does not use
        other[used] = -np.inf
        last = grid.at[size] + np.arange(len(words))
        back, second = np.full(s.shape[1], -np.inf), np.full(len(words), -np.inf)     # best score from a place on, and over another piece
        back[last] = 0
        for p, n in reversed(grid.steps):
            k = reach[p + n]
            here, rest = slice(at[p], at[p] + k), back[at[p + n]:at[p + n] + k]
            np.maximum(back[here], s[n - 1, here] + rest, out=back[here])
            np.maximum(second[:k], ahead[here] + other[n - 1, here] + rest, out=second[:k])
        number = np.full(len(text), -1, np.int32)                                # of the pieces, where they begin in the text
        number[grid.first[word] + step] = grid.number[used]
        begin = np.flatnonzero(number >= 0)
        piece = number[begin]
        many = np.ones(len(piece), np.int64)
        odd = np.flatnonzero(piece == 0)                                              # characters that are no piece: their bytes
        spelled = [self.ids(text[i]) for i in begin[odd].tolist()]
        many[odd] = list(map(len, spelled))
        ids, to = np.repeat(self.id_of[piece], many).astype(np.int32), np.cumsum(many) - many
        for i, x in zip(odd.tolist(), spelled, strict=True):
            ids[to[i]:to[i] + many[i]] = x
        of = np.repeat(np.arange(len(words)), np.bincount(word, minlength=len(words)))
        return ahead[last], ahead[last] - second, np.bincount(of, weights=many, minlength=len(words)).astype(np.int64), ids

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a part: score and ids, best first."""
        size = len(part)
        if size == 1:
            s = self.grow.get(part)
            return [(self.unknown if s is None else s, self.ids(part))]
        arrive, best = self.forward(part)
        out: list[tuple[float, tuple[int, ...]]] = []
        queue = [(-best[size], 0, size, 0.0, None)]     # (-total, number, place, score behind, pieces behind)
        number, push, pop = 0, heapq.heappush, heapq.heappop
        while queue and len(out) < n:
            total, _, place, gone, behind = pop(queue)
            if place == 0:
                ids: list[int] = []
                while behind is not None:
                    i, j, behind = behind
                    ids += self.ids(part[i:j])
                out.append((-total, tuple(ids)))
                continue
            for i, s, b in arrive[place]:
                number -= 1                               # of equal totals, the deepest path first
                push(queue, (-(b + s + gone), number, i, s + gone, (i, place, behind)))
        return out

    def word_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a word, from those of its parts."""
        got: list[tuple[float, tuple | None]] = [(0.0, None)]         # score, ids as a chain of parts
        for part in self.parts(word):
            more = self.n_best(part, n)
            got = sorted(((a + b, (x, y)) for a, x in got for b, y in more), key=lambda t: -t[0])[:n] \
                if len(got) > 1 or len(more) > 1 else [(got[0][0] + more[0][0], (got[0][1], more[0][1]))]
        out = []
        for score, chain in got:
            parts = []
            while chain is not None:
                chain, ids = chain
                parts.append(ids)
            out.append((score, tuple(i for ids in reversed(parts) for i in ids)))
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        return _decode(self.raw, ids)


def _raw(pieces: list[tuple[str, float, str]]) -> list[bytes]:
    """What each id decodes to."""
    return [p.replace(MARK, " ").encode() if kind == "normal" else bytes([int(p[1:-1], 16)]) if kind == "byte" else b""
            for p, _, kind in pieces]


def _decode(raw: list[bytes], ids) -> str:
    return b"".join(map(raw.__getitem__, ids))[1:].decode("utf-8")


class Encoder:
    """Encodes texts; remembers words it has seen."""

    def __init__(self, lattice: Lattice, n: int):
        self.lattice, self.n = lattice, n
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}                                # by the word as the text has it
        self.score = np.zeros(0)
        self.loss = np.zeros(0)
        self.uses = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)                             # the best segmentation's in ``ids``
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<i4")
        self.others: dict[int, list[tuple[float, bytes]]] = {}
        self.word_bytes = 0

    def _forget(self) -> None:
        """Keep the words used most, half of them at most and none used once; older uses count half."""
        words, k = list(self.place), np.flatnonzero(self.uses > 1)
        k = np.sort(k[np.argsort(-self.uses[k], kind="stable")[:len(words) // 2]])
        got = self.score[k], self.loss[k], self.begin[k], self.size[k], self.ids
        uses = self.uses[k] // 2
        self._clear()
        if len(k):
            self._remember([words[i] for i in k.tolist()], *got)
            self.uses = uses

    def _remember(self, words: list[str], score: np.ndarray, loss: np.ndarray, begin: np.ndarray, size: np.ndarray,
                  ids: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        add = lambda old, new: np.concatenate([old, new])
        self.score, self.loss, self.size = add(self.score, score), add(self.loss, loss), add(self.size, size)
        self.uses = add(self.uses, np.zeros(len(words), np.int64))
        self.begin = add(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.ids = add(self.ids, ids[_stretches(begin, size)])
        self.word_bytes += 220 * len(words) + 2 * sum(map(len, words)) + 4 * int(size.sum())

    def _others(self, word: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of the next best segmentations of a word."""
        k = self.place[word]
        if k not in self.others:
            best = self.ids[self.begin[k]:self.begin[k] + self.size[k]].tobytes()
            got = [(s, _ids(x)) for s, x in self.lattice.word_best(_form(word), self.n)]
            self.others[k] = [(got[0][0] - s, x) for s, x in got if x != best][:self.n - 1]
            self.word_bytes += 150 + sum(150 + len(x) for _, x in self.others[k])
        return self.others[k]

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a text: score and ids (little-endian
        32-bit numbers), best first.  An empty text has one, the empty one."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[list[tuple[float, bytes]]]:
        if self.word_bytes > _WORD_BYTES:
            self._forget()
        words, first = self.lattice.words(texts)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = self.place
        new = [w for w in distinct if w not in place]
        if new:
            self._remember(new, *self.lattice.best(new))
        known = np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.uses[known] += np.bincount(which, minlength=len(distinct))
        at = known[which]
        size = self.size[at]
        cut = np.append(0, np.cumsum(size)) * 4
        ids = self.ids[_stretches(self.begin[at], size)].tobytes()
        score, loss = self.score[at], self.loss[at]
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            few = self._few(loss[lo:hi])
            others = [self._others(distinct[which[lo + i]]) for i in few]
            out.append(self._best_of(float(score[lo:hi].sum()), ids[cut[lo]:cut[hi]], others,
                                     [(int(cut[lo + i] - cut[lo]), int(cut[lo + i + 1] - cut[lo])) for i in few]))
        return out

    def _few(self, loss: np.ndarray) -> list[int]:
        """The words in which another segmentation among the n best can deviate:
        those whose smallest loss is among the n - 1 smallest."""
        few = np.lexsort((np.arange(len(loss)), loss))[:self.n - 1] if len(loss) < 64 else _smallest(loss, self.n - 1)
        return few.tolist()

    def _best_of(self, total: float, ids: bytes, others: list[list[tuple[float, bytes]]],
                 where: list[tuple[int, int]]) -> list[tuple[float, bytes]]:
        """The n best of a text: its best one, and the ways to change words of it."""
        out = [(total, ids)]
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for place, other in zip(where, others, strict=True):
            ways += [(d + e, (*x, (place, y))) for d, x in ways for e, y in other]
            ways = sorted(ways, key=lambda t: t[0])[:self.n]
        for lost, changes in sorted(ways, key=lambda t: t[0])[1:self.n]:
            parts, done = [], 0
            for (lo, hi), y in sorted(changes):
                parts += [ids[done:lo], y]
                done = hi
            out.append((total - lost, b"".join([*parts, ids[done:]])))
        return out


def _form(words: str) -> str:
    """Words of a text in the lattice's form (of the same length)."""
    return words.replace(MARK, _OWN_MARK).replace(" ", MARK)


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of stretches, one after another."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


def _smallest(loss: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest losses, the earlier one first on ties."""
    if k <= 0:
        return np.zeros(0, np.int64)
    limit = np.partition(loss, k - 1)[k - 1]
    at = np.flatnonzero(loss <= limit)
    return at[np.lexsort((at, loss[at]))][:k]


def _ids(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def model_pieces(path: str | None = None) -> list[tuple[str, float, str]]:
    """Pieces of a SentencePiece model file (by default the public 32k one)."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    other = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i), "byte" if sp.is_byte(i) else "other" if other(i) else "normal")
            for i in range(sp.get_piece_size())]


_cache: dict[tuple, Encoder] = {}


def _encoder(pieces: list[tuple[str, float, str]], n: int) -> Encoder:
    """Kept by the worker from task to task: a lattice and the memory for words."""
    key = (n, len(pieces), hash(tuple(pieces)))
    if key not in _cache:
        _cache.clear()
        _cache[key] = Encoder(Lattice(pieces), n)
    return _cache[key]


def encode(docs: DataFrame, n: int = 3, path: str | None = None) -> DataFrame:
    """``docs`` with an array column ``segmentations`` appended: the ``n`` best
    as (score, ids), ids being little-endian 32-bit numbers.  If the name is
    taken, underscores are added."""
    name = free_name(docs, "segmentations")
    pieces = docs.sparkSession.sparkContext.broadcast(model_pieces(path))       # the fixed vocabulary
    one = F.struct(F.lit(0.0).alias("score"), F.lit(b"").alias("ids"))
    schema = docs.withColumn(name, F.array(one)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pieces.value, n)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))
        for b in batches:
            for part in _slices(b, "text"):
                got = [[{"score": s, "ids": x} for s, x in each] for each in encoder.encode_all(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, kind)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_SLICE`` bytes of a column (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = np.arange(0, int(size[-1]) + 1 if len(size) else 0, _SLICE)
    cuts = np.unique(np.append(np.searchsorted(size, at), batch.num_rows)).tolist()
    for lo, hi in zip([0, *cuts], cuts, strict=False):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def _texts(raw: pa.Array, ids: pa.Array) -> pa.Array:
    """The texts of a column of ids; ``raw``: what each id decodes to."""
    data, offsets = buffers(ids)
    got = raw.take(pa.array(data.view("<i4")))
    data, ends = buffers(got)
    offsets = ends[offsets // 4]
    begin = offsets[:-1][np.diff(offsets) > 0]                          # a text without the space put in front
    texts = pa.LargeStringArray.from_buffers(
        len(ids), pa.py_buffer(offsets - np.append(0, np.cumsum(np.diff(offsets) > 0))), pa.py_buffer(np.delete(data, begin)))
    texts.validate(full=True)                                           # raises if a text is no UTF-8
    return pc.if_else(ids.is_valid(), texts.cast(pa.string()), pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, ids: str, path: str | None = None) -> DataFrame:
    """``encoded`` with the binary column ``ids`` replaced by the text it stands for."""
    pieces = encoded.sparkSession.sparkContext.broadcast(model_pieces(path))
    schema = encoded.withColumn(ids, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pa.array(_raw(pieces.value), pa.large_binary())
        for b in batches:
            for part in _slices(b, ids):
                yield pa.RecordBatch.from_arrays(
                    [_texts(raw, part.column(ids)) if f.name == ids else part.column(f.name) for f in part.schema],
                    names=part.schema.names)

    return encoded.mapInArrow(run, schema)
