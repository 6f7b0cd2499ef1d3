"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The *ledger* keeps, per document,
the measurements and one integer whose bit ``i`` says that rule ``i`` failed.
A *policy* is a named, versioned set of rules, i.e. a mask: a document is kept
if ``failed & mask = 0``.  Policies are applied to a stored ledger without
reading text again, and ablations (what would be kept without rule ``i``) come
from one small aggregate of failure masks.

Only DataFrame functions are used.  The one costly measurement, repeated
word windows, sorts the window hashes of one document inside an array
expression, so no word ever crosses a shuffle.

Defined results: NULL and empty texts have 0 words and fail ``few_words``;
a document with fewer than three words has no window; rows are answered one
by one, so repeated rows repeat their result.
Texts of any length are measured
whole; an empty table gives an empty ledger; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CLASS = r"[ \t\n\x0B\f\r]+"
#: Fixed values of the word and symbol classes.
SPACES = " \t\n\x0b\f\r"
SYMBOL_CLASS = "[#*$%&|<>]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Window hashes (64 bits, within one document) are sorted with their
    positions; neighbours with equal hash are repeats.  The covered words follow from the sorted
    repeat positions: each adds the distance to the next one, at most three.
    """
    windows = F.slice(F.transform(w, lambda x, i: F.struct(
        F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))), F.lit(1), F.size(w) - 2)

    def positions(s: Column) -> Column:
        repeats = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
        return F.sort_array(F.transform(repeats, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))),
                       lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
            F.lit(0), lambda acc, x: acc + x)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(
        _let(F.sort_array(windows), lambda s: _let(positions(s), covered))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition over the measurements."""

    name: str
    failed: Column


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    split = docs.select(
        "doc_id",
        F.filter(F.split(t, SPACE_CLASS), lambda x: x != "").alias("w"),
        F.regexp_count(t, F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
        lines.alias("lines"))
    return split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"))


def default_rules() -> list[Rule]:
    """Rules in bit order; append only, so that stored ledgers keep their meaning."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 50),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * n),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 15 * n),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("low_variety", 100 * F.col("n_distinct_words") < 5 * n),
    ]


BASE = ("few_words", "repeated_windows")
POLICIES = (
    Policy("base", 1, BASE),
    Policy("standard", 1, (*BASE, "symbols")),
    Policy("standard", 2, (*BASE, "symbols", "short_words", "long_words", "duplicate_lines", "low_variety")),
)


def ledger(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Measurements plus ``failed_bits`` (bit i set: rule i failed)."""
    rules = default_rules() if rules is None else rules
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("failed_bits", bits)


def mask_of(names: tuple[str, ...], rules: list[Rule] | None = None) -> int:
    order = [r.name for r in (default_rules() if rules is None else rules)]
    return sum(1 << order.index(n) for n in set(names))


def passes(policy: Policy, rules: list[Rule] | None = None) -> Column:
    """Whether a ledger row passes ``policy``."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy.rules, rules)).cast("long")) == 0


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: list[Rule] | None = None) -> DataFrame:
    """Per policy and rule of it: documents, failures of the rule, documents
    that only this rule removes, and kept documents with and without the rule.

    The ledger is reduced to one row per failure mask first; everything after
    is bitwise arithmetic over those few rows."""
    rules = default_rules() if rules is None else rules
    order = [r.name for r in rules]
    masks = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    plan = F.array(*[
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
                 F.lit(mask_of(p.rules, rules)).cast("long").alias("mask"),
                 F.lit(1 << order.index(r)).cast("long").alias("bit"))
        for p in policies for r in p.rules])
    x = masks.select("failed_bits", "n", F.explode(plan).alias("x")).select("failed_bits", "n", "x.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("long")
    return x.groupBy("policy", "version", "rule").agg(
        F.sum("n").cast("long").alias("n_docs"),
        n(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n(hit == F.col("bit")).alias("n_only_this"),
        n(hit == 0).alias("n_kept"),
        n((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"))
