"""Minimal perfect hash of a set of 64-bit keys, in levels.

Keys that meet no other key in a level's bits are placed there, the rest go on
to the next level with another hash.  The rank of a key's bit among all set
bits is its slot, so n keys have the slots 0..n-1.  The keys stand in their
slots: a key that was never placed is told from those that were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .lexer import U64, mix

_SPREAD = 2                # bits of a level for each key that reaches it
_STEP = U64(0x9E3779B97F4A7C15)


def _place(keys: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(keys.astype(U64) * _STEP + U64(level + 1) * U64(0xD1B54A32D192ED03))
    return ((h >> U64(33)) % np.asarray(bits, U64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Bits of each level, and the keys of each level in the order of their bits."""
    sizes, placed, level = [], [], 0
    while len(keys):
        size = _SPREAD * len(keys) + 1
        at = _place(keys, level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        sizes.append(size)
        placed.append(keys[alone][np.argsort(at[alone])])
        keys, level = keys[~alone], level + 1
    return sizes, placed


@dataclass
class PairHash:
    """The hash over several groups of keys: ``group_of`` is a hash of the key
    modulo their number, so every group's levels stand side by side."""

    sizes: np.ndarray          # group x level: bits (0: the group has no such level)
    offset: np.ndarray         # group x level: first bit among all bits
    words: np.ndarray          # all bits
    before: np.ndarray         # set bits before each word
    keys: np.ndarray           # the key in each slot

    @classmethod
    def of(cls, groups: list[tuple[list[int], list[np.ndarray]]]) -> PairHash:
        depth = max((len(s) for s, _ in groups), default=0)
        sizes = np.zeros((len(groups), max(1, depth)), np.int64)
        for g, (s, _) in enumerate(groups):
            sizes[g, :len(s)] = s
        offset = (np.cumsum(sizes.reshape(-1)) - sizes.reshape(-1)).reshape(sizes.shape)
        total = int(sizes.sum())
        words = np.zeros(total // 64 + 1, U64)
        for g, (_, placed) in enumerate(groups):
            for level, keys in enumerate(placed):
                at = offset[g, level] + _place(keys, level, sizes[g, level])
                np.bitwise_or.at(words, at >> 6, U64(1) << (at & 63).astype(U64))
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
        keys = np.concatenate([k for _, placed in groups for k in placed] or [np.zeros(0, np.int64)])
        return cls(sizes, offset, words, before, keys)

    def group_of(self, keys: np.ndarray) -> np.ndarray:
        return group_of(keys, len(self.sizes))

    def slots(self, keys: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """Slot of each key, -1 for a key that has none."""
        out = np.full(len(keys), -1, np.int64)
        group = self.group_of(keys) if group is None else group
        live = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[group[live], level]
            live, size = live[size > 0], size[size > 0]
            if not len(live):
                break
            at = self.offset[group[live], level] + _place(keys[live], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            hit = ((word >> bit) & U64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            out[live[hit]] = self.before[at[hit] >> 6] + below
            live = live[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def group_of(keys: np.ndarray, n_groups: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(keys.astype(U64) ^ U64(0xA0761D6478BD642F))
    return ((h >> U64(20)) % U64(max(1, n_groups))).astype(np.int64)
