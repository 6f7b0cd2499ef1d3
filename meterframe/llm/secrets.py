"""Secret scan with inferred credential grammars.

Three patterns with known form are found first (assignments to a name such as
``password``, access keys, long hexadecimal strings).  Their values are
labelled credentials.  For each kind, a prefix tree of their values is
generalised into a probabilistic automaton by merging states whose next-symbol
and end frequencies do not differ significantly (Hoeffding bound).  A further
automaton is inferred from other long strings.  Every remaining candidate (a
long run of credential characters) is then scored: the log-likelihood under
the best credential automaton minus that under the automaton of ordinary
strings, in bits per character.  Candidates above the threshold are found too,
as kind ``grammar``.

Symbols are character classes; within a class characters are equally likely.
The prefix trees are counted over the distinct values of all documents, those
of the credentials and of the ordinary strings alike; nothing is sampled.

Defined results: NULL and empty texts have no spans; spans are in code points,
end exclusive; repeated rows repeat their result; without labelled credentials
only the base patterns count.
Texts of any length are scanned whole; an empty
table gives an empty result; columns that clash with the operator's keep their
values, its own get underscores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import free_name, materialize

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")       # the same matches as HEX of 32 or more characters
KINDS = ("assign", "access", "hex", "grammar")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.01      # significance of the compatibility test
    evidence: int = 12       # states seen less often are not tested
    bits: float = 0.75       # threshold: bits per character above ordinary strings


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX_LONG.finditer(text)]
    return out


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters that no base span touches."""
    taken = sorted((s, e) for _, s, e, _ in base)
    i = 0
    for m in CANDIDATE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        # spans of different kinds may nest, so look at all that begin before the end
        if not any(s < m.end() and e > m.start() for s, e in taken[max(0, i - 3):i + 4]):
            yield m.start(), m.end(), m[0]


def _classes() -> dict[str, tuple[str, float]]:
    """Class and log2 probability within the class of every ASCII character."""
    groups = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]
    out = {chr(c): (chr(c), 0.0) for c in range(128)}
    for g in groups:
        for c in g:
            out[c] = (g[0], -math.log2(len(g)))
    return out


_CLASS = _classes()


@dataclass
class Automaton:
    """Probabilistic automaton: for each state the log2 probability of ending
    and, by symbol, the next state and log2 probability."""

    end: list[float] = field(default_factory=list)
    step: list[dict[str, tuple[int, float]]] = field(default_factory=list)

    UNSEEN = -12.0

    def log_likelihood(self, value: str) -> float:
        """log2 probability; a symbol never seen in a state keeps the state."""
        state, total = 0, 0.0
        for c in value:
            symbol, inside = _CLASS[c]
            to = self.step[state].get(symbol)
            if to is None:
                total += self.UNSEEN + inside
            else:
                state = to[0]
                total += to[1] + inside
        return total + max(self.end[state], self.UNSEEN)


@dataclass
class Tree:
    """Prefix tree with counts.  ``use`` counts each (node, symbol); a symbol in
    ``back`` has too few values for a node of its own and leads to the root."""

    seen: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    child: list[dict[str, int]] = field(default_factory=lambda: [{}])
    back: list[set[str]] = field(default_factory=lambda: [set()])
    use: dict[tuple[int, str], int] = field(default_factory=dict)

    def add(self, node: int, symbol: str) -> int:
        to = self.child[node][symbol] = len(self.child)
        self.child.append({})
        self.back.append(set())
        self.seen.append(0)
        self.ends.append(0)
        return to


def infer(values: list[str], alpha: float, evidence: int) -> Automaton:
    """The automaton of the whole prefix tree of ``values``."""
    tree = Tree()
    for v in values:
        node = 0
        tree.seen[0] += 1
        for c in v:
            s = _CLASS[c][0]
            to = tree.child[node].get(s)
            to = tree.add(node, s) if to is None else to
            tree.use[node, s] = tree.use.get((node, s), 0) + 1
            node = to
            tree.seen[node] += 1
        tree.ends[node] += 1
    return merged(tree, alpha, evidence)


def merged(tree: Tree, alpha: float, evidence: int) -> Automaton:
    """Merge compatible prefix-tree states (red-blue order) into an automaton."""
    seen, ends, child, back, use = tree.seen, tree.ends, tree.child, tree.back, tree.use
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > factor * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if min(seen[x], seen[y]) < evidence:
                continue
            if differ(ends[x], seen[x], ends[y], seen[y]):
                return False
            for s in child[x].keys() | child[y].keys() | back[x] | back[y]:
                if differ(use.get((x, s), 0), seen[x], use.get((y, s), 0), seen[y]):
                    return False
                if s in child[x] and s in child[y]:
                    todo.append((child[x][s], child[y][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            seen[x] += seen[y]
            ends[x] += ends[y]
            for s, to in child[y].items():
                use[x, s] = use.get((x, s), 0) + use[y, s]
                if s in child[x]:
                    todo.append((child[x][s], to))
                else:
                    child[x][s] = to
                    back[x].discard(s)
            for s in back[y]:
                use[x, s] = use.get((x, s), 0) + use[y, s]
                if s not in child[x]:
                    back[x].add(s)

    red, at = [0], 0
    is_red = {0}
    while at < len(red):
        for s in sorted(child[red[at]]):
            blue = child[red[at]][s]
            if blue in is_red:
                continue
            into = next((r for r in red if compatible(r, blue)), None)
            if into is None:
                red.append(blue)
                is_red.add(blue)
            else:
                child[red[at]][s] = into
                fold(into, blue)
        at += 1
        if at == len(red) and any(to not in is_red for r in red for to in child[r].values()):
            at = 0                       # folding gave an earlier state new successors
    place = {r: i for i, r in enumerate(red)}
    out = Automaton()
    for r in red:
        total = max(1, seen[r])
        out.end.append(math.log2(ends[r] / total) if ends[r] else Automaton.UNSEEN)
        steps = {**dict.fromkeys(back[r], 0), **child[r]}
        out.step.append({s: (place[to], math.log2(use[r, s] / total)) for s, to in sorted(steps.items())})
    return out


def class_counts(docs: DataFrame) -> DataFrame:
    """(label, classes, n): number of distinct values of all documents by label
    and class string; label 0 to 2 are the base kinds, 3 ordinary strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], None] = {}
        for b in batches:
            for t in b.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                for kind, _, _, value in base:
                    found[kind, value] = None
                for _, _, value in candidates(text, base):
                    found[3, value] = None
                if len(found) > 50_000:
                    yield _batch(found)
                    found = {}
        yield _batch(found)

    def _batch(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()),
                                           pa.array([v for _, v in found], pa.string())], names=["label", "value"])

    chars = [c for c in _CLASS if _CLASS[c][0] != c]
    classes = F.translate("value", "".join(chars), "".join(_CLASS[c][0] for c in chars))
    return docs.select("text").mapInArrow(run, "label int, value string").distinct() \
        .groupBy("label", classes.alias("classes")).agg(F.count("*").alias("n"))


_COUNTED = "label int, node long, symbol string, n long"


def _counted(rows: DataFrame, walk) -> DataFrame:
    """Sums of ``n`` over all rows by what ``walk(label, classes)`` yields: (node, symbol)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, str], int] = {}
        for b in batches:
            for label, classes, n in zip(*(b.column(c).to_pylist() for c in ("label", "classes", "n")), strict=True):
                for node, symbol in walk(label, classes):
                    counts[label, node, symbol] = counts.get((label, node, symbol), 0) + n
                if len(counts) > 200_000:
                    yield _batch(counts)
                    counts = {}
        yield _batch(counts)

    def _batch(counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int64()),
             pa.array([k[2] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())],
            names=["label", "node", "symbol", "n"])

    return rows.mapInArrow(run, _COUNTED).groupBy("label", "node", "symbol").agg(F.sum("n").alias("n"))


def _below(node: int, symbol: str) -> int:
    """Number of the prefix-tree node below ``node``; that of the root is 0."""
    return xxhash.xxh64_intdigest(symbol, node) >> 1


def _prefixes(label: int, classes: str) -> Iterator[tuple[int, str]]:
    node = 0
    for s in classes:
        yield node, s
        node = _below(node, s)


def trees(docs: DataFrame, evidence: int) -> dict[int, Tree]:
    """The prefix tree of each label, counted over the values of all documents.

    Nodes with ``evidence`` values or more are kept.  A value that leaves them
    goes on from the root with its next symbol, where merging would put it, so
    each symbol and end of each value is counted.  The driver gets the kept
    nodes and the counts at them, never the values."""
    rows = materialize(class_counts(docs), "secret-classes")
    below: dict[tuple[int, int], list[str]] = {}
    for r in _counted(rows, _prefixes).where(F.col("n") >= evidence).collect():
        below.setdefault((r.label, r.node), []).append(r.symbol)
    out = {r.label: Tree() for r in rows.select("label").distinct().collect()}
    for label, tree in out.items():
        todo = [(0, 0)]
        for node, number in todo:
            todo += [(tree.add(node, s), _below(number, s)) for s in sorted(below.get((label, number), []))]
    shared = docs.sparkSession.sparkContext.broadcast({label: tree.child for label, tree in out.items()})

    def walk(label: int, classes: str) -> Iterator[tuple[int, str]]:
        child, node = shared.value[label], 0
        for s in classes:
            yield node, s
            node = child[node].get(s, 0)
        yield node, ""                                                      # the end

    for r in _counted(rows, walk).collect():
        tree = out[r.label]
        tree.seen[r.node] += r.n
        if r.symbol:
            tree.use[r.node, r.symbol] = r.n
            if r.symbol not in tree.child[r.node]:
                tree.back[r.node].add(r.symbol)
        else:
            tree.ends[r.node] = r.n
    return out


@dataclass(frozen=True)
class Grammar:
    credentials: list[Automaton]
    ordinary: Automaton | None
    settings: Settings

    def score(self, value: str) -> float:
        """Bits per character by which a credential grammar explains ``value`` better than ordinary strings."""
        if not self.credentials or self.ordinary is None:
            return -math.inf
        best = max(a.log_likelihood(value) for a in self.credentials)
        return (best - self.ordinary.log_likelihood(value)) / len(value)


def learn(docs: DataFrame, settings: Settings | None = None) -> Grammar:
    """Infer the grammars from the values of all documents."""
    s = settings or Settings()
    found = {i: merged(t, s.alpha, s.evidence) for i, t in trees(docs, s.evidence).items()}
    return Grammar([found[i] for i in range(3) if i in found], found.get(3), s)


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with a column ``spans`` appended: kind, start and end of every
    secret, by start and kind.  If the name is taken, underscores are added."""
    name = free_name(docs, "spans")
    shared = docs.sparkSession.sparkContext.broadcast(grammar)        # a few automata
    schema = docs.withColumn(name, F.lit(None).cast(SPANS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, kind = shared.value, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for t in b.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                found = [(s, k, e) for k, s, e, _ in base]
                found += [(s, 3, e) for s, e, v in candidates(text, base) if g.score(v) >= g.settings.bits]
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, grammar: Grammar, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced in ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            out = []
            for t in b.column("text"):
                text = t.as_py()
                if text:
                    base = base_spans(text)
                    spans = [(s, e) for _, s, e, _ in base]
                    spans += [(s, e) for s, e, v in candidates(text, base) if g.score(v) >= g.settings.bits]
                    text = _replace(text, sorted(spans), mark)
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, f.type) if f.name == "text" else b.column(f.name) for f in b.schema],
                names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _replace(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
