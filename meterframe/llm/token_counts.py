"""Token counts by a compiled finite-state tokenizer.

The vocabulary file (JSON, byte-level BPE with a word-end suffix) is compiled
into two machines.

*Words.*  The lexical rule of the file cuts the normalised text into words.

*Tokens.*  A deterministic transducer reads the bytes of one word; each
transition carries the number of tokens it adds.  Merging by rank has the
property that an encoding is right exactly if every pair of neighbouring
tokens is: the merges applied to their characters give the two back.  So the
encoding of a prefix ends in exactly one token that fits the last token of
the shorter prefix before it.  The state keeps, for every earlier place from
which a vocabulary entry could still reach further, the trie node reached
from there, the last token and the number of tokens up to there, relative to
the current place.  States and transitions are compiled when first needed and
kept; there are finitely many, because vocabulary entries have bounded length.

*Chunks.*  White space puts the machine into its start state, whatever came
before.  The effect of a chunk of text is therefore a small state map: the
text before its first white space, the tokens in between, the text after its
last one.  Maps compose associatively, and a document's chunks are combined
pairwise as a scan, so its count does not depend on where it was cut.

Defined results: NULL and empty texts have 0 tokens; special tokens of the
file occurring in a text count as one token each (the library's default);
repeated rows repeat their result.
Texts of any length are counted whole; an empty
table gives an empty result; further columns, whatever their names, are no matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import free_name

CHUNK = 1 << 16            # code points
_MEMO = 1 << 19            # words whose count a task remembers
_STATES = 1 << 18          # compiled states a task keeps; beyond, it compiles afresh
#: White space in the sense of Unicode (a fixed value).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Transducer:
    """Tokens per word, compiled from vocabulary and merge ranks."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        letters = _byte_letters()
        self.letters, self.suffix = letters, suffix
        self.child: list[dict[str, int]] = [{}]          # trie over the letters of all tokens
        self.inner: list[tuple[str, ...] | None] = [None]  # symbols of the token that ends at a node
        self.last: list[tuple[str, ...] | None] = [None]   # the same with the word-end suffix
        for c in letters:
            self._add((c,), False)
            self._add((c + suffix,), True)
        for a, b in merges:
            whole = a + b
            ends = whole.endswith(suffix)
            text = whole[:-len(suffix)] if ends else whole
            symbols = (*text[:-1], text[-1] + suffix) if ends else tuple(text)
            self._add(symbols, ends)
        self._restart()

    def _restart(self) -> None:
        """Nothing compiled but the start state."""
        self.pairs: dict[tuple, bool] = {}
        self.states: dict[tuple, int] = {((0, None, 0),): 0}
        self.about: list[tuple] = [((0, None, 0),)]
        self.step: list[dict[int, tuple[int, int]]] = [{}]  # byte -> (next state, tokens added)
        self.final: list[int | None] = [None]               # tokens added by the end of the word

    def _add(self, symbols: tuple[str, ...], ends: bool) -> None:
        node = 0
        for s in symbols:
            c = s[0]
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.inner.append(None)
                self.last.append(None)
            node = self.child[node][c]
        (self.last if ends else self.inner)[node] = symbols

    def merge(self, symbols: tuple[str, ...]) -> list[str]:
        """Byte-pair merging by rank: the definition the machine is compiled from."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1),
                       key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, before: tuple[str, ...] | None, token: tuple[str, ...]) -> bool:
        """Whether ``token`` may follow ``before`` in an encoding."""
        got = self.pairs.get((before, token))
        if got is None:
            want = ["".join(token)] if before is None else ["".join(before), "".join(token)]
            got = self.pairs[before, token] = self.merge((before or ()) + token) == want
        return got

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        c, places, reached = self.letters[byte], [], None
        for node, before, count in self.about[state]:
            to = self.child[node].get(c)
            if to is None:
                continue
            token = self.inner[to]
            if reached is None and token is not None and self.fits(before, token):
                reached = (token, count + 1)
            if self.child[to] or self.last[to] is not None:
                places.append((to, before, count))
        token, total = reached
        key = (*((n, b, k - total) for n, b, k in places), (0, token, 0))
        if key not in self.states:
            self.states[key] = len(self.about)
            self.about.append(key)
            self.step.append({})
            self.final.append(None)
        self.step[state][byte] = out = (self.states[key], total)
        return out

    def _finish(self, state: int) -> int:
        for node, before, count in self.about[state]:
            token = self.last[node]
            if token is not None and self.fits(before, token):
                self.final[state] = count + 1
                return count + 1
        raise AssertionError("every byte is a token at the end of a word")

    def count(self, word: bytes) -> int:
        if len(self.about) > _STATES:
            self._restart()
        state, total, step = 0, 0, self.step
        for byte in word:
            to = step[state].get(byte)
            if to is None:
                to = self._compile(state, byte)
            state, more = to
            total += more
        last = self.final[state]
        return total + (self._finish(state) if last is None else last)


#: Below this, all versions of the Unicode tables agree on letters and case.
_SETTLED = regex.compile("[\u0558-\U0010ffff]")


def _newer(text: str) -> bool:
    """Whether a character is unknown to Python's Unicode tables."""
    return _SETTLED.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))


class _Counts(dict):
    """Words seen so far with their number of tokens."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word.encode("utf-8", "surrogatepass"))
        if len(self) >= _MEMO:
            self.clear()
        self[word] = n
        return n


class Tokenizer:
    """Compiled from the JSON text of a vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(merges, model.get("end_of_word_suffix") or "")
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(rule.replace(r"\s", _SPACE)).findall
        self.space = regex.compile(f"[{_SPACE}]+")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known = _Counts(self.machine)
        self.spec, self.library = text, None
        self.byte = {c: b for b, c in enumerate(self.machine.letters)}

    def _plain(self, text: str) -> int:
        if not text.isascii():
            if _newer(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")   # no final-sigma rule
        text = "".join(map(str.lower, text)) if "İ" in text else text.lower()
        return sum(map(self.known.__getitem__, self.words(text)))

    def _by_library(self, text: str) -> int:
        """Texts with characters newer than Python's Unicode tables: the
        library normalises them and cuts them into words."""
        if self.library is None:
            from tokenizers import Tokenizer as Library
            self.library = Library.from_str(self.spec)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.machine.count(bytes([self.byte[c] for c in w])) for w, _ in cut)

    def fragment(self, text: str) -> int:
        """Tokens of a text that begins and ends at white space or an end."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(text before the first white space, tokens in between, text after
        the last one); the middle is None if there is no white space."""
        first = self.space.search(text)
        if first is None:
            return text, None, ""
        last = len(text)
        while not self.space.match(text[last - 1]):
            last -= 1
        return text[:first.start()], self.fragment(text[first.end():last]) if last > first.end() else 0, text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.fragment(a[2] + b[0]) + b[1], b[2])

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.fragment(text)
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:                                  # pairwise, as in a parallel scan
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i]
                    for i in range(0, len(maps), 2)]
        head, middle, tail = maps[0]
        if middle is None:
            return self.fragment(head)
        return self.fragment(head) + middle + self.fragment(tail)


def vocabulary(path: str | None = None) -> str:
    """JSON text of the vocabulary file (by default the public word BPE); its
    size is that of the fixed vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with a long column ``n_tokens`` appended (underscores are added
    if the name is taken)."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    name = free_name(docs, "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _compiled(spec.value)
        for b in batches:
            n = [tokenizer.count(t.as_py() or "", chunk) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema)


_cache: dict[int, Tokenizer] = {}


def _compiled(text: str) -> Tokenizer:
    """The machine is kept by the worker from task to task."""
    key = hash(text)
    if key not in _cache:
        _cache.clear()
        _cache[key] = Tokenizer(text)
    return _cache[key]
