"""The pieces of a fixed vocabulary in whole blocks of words at once.

Piece numbers come from a rolling hash of the characters, which is only carried
on while the characters begin some piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .lexer import U64, mix

MARK = "▁"
_K = U64(0x9E3779B97F4A7C15)
BLOCK = 1 << 15            # characters that are worked on together


class Pieces:
    """Piece numbers by rolling hash.  Number 0 is the unknown character."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        number = {p[:i]: 0 for p in pieces for i in range(1, len(p))} | {p: i + 1 for i, p in enumerate(pieces)}
        of_size: dict[int, list[str]] = {}
        for p in number:                                # beginnings of pieces, those that are none with number 0
            of_size.setdefault(len(p), []).append(p)
        hashes = np.concatenate([self._hashes(p, n) for n, p in of_size.items()])
        numbers = np.fromiter((number[p] for ps in of_size.values() for p in ps), np.int64, len(hashes))
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order]
        # first position in the sorted hashes for each leading 18 bits: one probe instead of a search
        self.slot = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << U64(46)).astype(np.int64)
        self.slot = np.append(self.slot, len(self.hashes))
        self.deepest = int(np.diff(self.slot).max())

    @staticmethod
    def _hashes(strings: list[str], n: int) -> np.ndarray:
        codes = np.array([[ord(c) for c in p] for p in strings], np.uint64).reshape(-1, n)
        h = np.zeros(len(codes), np.uint64)
        for k in range(n):
            h = h * _K + codes[:, k] + U64(1)
        return mix(h)

    def lookup(self, rolling: np.ndarray) -> np.ndarray:
        """Piece number for each rolling hash, 0 for the beginning of one, -1
        if there is none."""
        h = mix(rolling)
        lead = (h >> U64(46)).astype(np.int64)
        at, stop = self.slot[lead], self.slot[lead + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < stop)
        while len(live):
            found = self.hashes[at[live]] == h[live]
            out[live[found]] = self.numbers[at[live[found]]]
            live = live[~found]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


class PieceLattice:
    """The pieces in a block of words, all their places one after another.

    A word of n characters has n + 1 places; an arc is a piece from one place to
    another.  Words stand in order of length, the
    longest first, so that those still going on at any step come first."""

    def __init__(self, words: list[str], known: Pieces):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(size + 1) - (size + 1)
        self.last = self.first + size
        text = MARK.join(words) + MARK                                  # the marks between words only keep the places apart
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U64(1)
        stop = np.repeat(self.last, size + 1)
        live = np.flatnonzero(np.arange(len(codes)) < stop)
        rolling = codes[live]
        found = []
        for n in range(1, known.longest + 1):
            number = known.lookup(rolling)
            piece = number > 0 if n > 1 else np.ones(len(live), bool)   # a single character that is no piece is unknown
            found.append((live[piece], np.full(int(piece.sum()), n), np.maximum(number[piece], 0)))
            on = np.flatnonzero((number >= 0) & (live + n < stop[live]))
            if not len(on):
                break
            live = live[on]
            rolling = rolling[on] * _K + codes[live + n]
        start, n, self.number = (np.concatenate(x) for x in zip(*found, strict=True))
        self.start, self.end = start, start + n
        self.word = np.searchsorted(self.first, start, "right") - 1
        self.steps = int(size.max(initial=0))
        self.n_places = len(codes)


class PieceGrid:
    """The pieces in a block of words, place by place: the first places of all
    words, then their second ones, and so on.

    Words stand in order of length, the longest first, so that the words that
    have a place are the first ones at every place, and a step of any search
    over the pieces is an operation on whole stretches.  Place ``p`` of word
    ``w`` is ``at[p] + w``, for the first ``reach[p]`` words."""

    def __init__(self, text: str, size: np.ndarray, known: Pieces):
        """``text``: the words, each with one more character after it, which
        only keeps the places apart."""
        self.first = np.cumsum(size + 1) - (size + 1)                   # first place of a word in the text
        self.reach = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "right")
        self.at = np.cumsum(self.reach) - self.reach
        word = np.repeat(np.arange(len(size)), size + 1)
        step = np.arange(len(word)) - self.first[word]
        spot = self.at[step] + word
        codes = np.empty(len(word), U64)
        codes[spot] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U64(1)
        more = np.zeros(len(word), bool)                                # places before a character
        more[spot] = step < size[word]
        after = np.empty(len(word), np.int64)
        after[spot[:-1]] = spot[1:]
        step = np.repeat(np.arange(len(self.reach)), self.reach)
        live = end = np.flatnonzero(more)
        rolling = codes[live]
        found, some = [], []
        for n in range(1, known.longest + 1):
            number = known.lookup(rolling)
            piece = number > 0 if n > 1 else np.ones(len(live), bool)   # a single character that is no piece is unknown
            start = live[piece]
            found.append((start, np.maximum(number[piece], 0)))
            some.append(np.zeros(len(self.reach), bool))
            some[-1][step[start]] = True
            end = after[end]
            on = np.flatnonzero((number >= 0) & more[end])
            if not len(on):
                break
            live, end = live[on], end[on]
            rolling = rolling[on] * _K + codes[end]
        #: number of the piece of n + 1 characters at each place, -1 if there is none
        self.number = np.full((len(found), len(codes)), -1, np.int32)
        for n, (start, number) in enumerate(found):
            self.number[n, start] = number
        self.found = found
        #: steps and lengths of pieces that any word has there, in this order
        self.steps = [(p, n + 1) for p, n in np.argwhere(np.array(some).T).tolist()]


def blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words in order of length, longest first, in blocks of about
    ``BLOCK`` characters."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    order = np.argsort(-size, kind="stable")
    block = (np.cumsum(size[order]) - 1) // BLOCK
    return (x for x in np.split(order, np.flatnonzero(np.diff(block)) + 1) if len(x))
