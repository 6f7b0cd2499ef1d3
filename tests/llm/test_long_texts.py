"""Very long texts, empty tables and clashing columns through every operator on documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterframe.llm import (
    decontamination,
    language_id,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepiece_nbest,
    simhash,
    substring_dedup,
    token_alignment,
    token_counts,
    toxicity,
)

N = 120_000
WORDS = np.array([f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "ng")])
LONG = " ".join(WORDS[np.random.default_rng(4).integers(0, len(WORDS), N)]) + " token = abcDEF123456xyz987\n"
ROWS = [(1, LONG, "en"), (2, LONG, "en"), (3, "short text", "en"), (4, None, None), (5, "", "de"), (6, "x" * 300_000, "de")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for name in ("key", "n", "shard", "a", "w", "spans", "quality", "toxicity", "language", "segmentations", "alignment", "fp"):
        df = df.withColumn(name, F.lit("own"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


def of(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    out = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(out)
    assert 1 not in out or out[1] == out[2] or len(out) != len(ROWS)
    return out


def test_rules(docs):
    got = of(quality_rules.ledger(docs), "n_words", "word_chars")
    assert got[1] == (N + 3, len("".join(LONG.split()))) and got[4] == got[5] == (0, 0) and got[6] == (1, 300_000)


def test_secrets(docs):
    model = secrets.learn(docs)
    found = of(secrets.scan(docs.drop("spans"), model), "spans")
    assert any(s["kind"] == "assign" for s in found[1][0]) and found[4] == found[5] == ([],)
    clean = of(secrets.redact(docs, model), "text")
    assert "abcDEF123456xyz987" not in clean[1][0] and len(clean) == len(ROWS)


def test_token_counts_and_alignment(docs):
    got = of(token_counts.count_tokens(docs), "n_tokens")
    assert got[1][0] > N and got[4] == got[5] == (0,) and got[6][0] > 0
    rows = of(token_alignment.alignment(docs.drop("alignment")), "alignment")
    assert rows[1][0]["n_a"] >= N and rows[1][0]["n_b"] >= N and rows[6][0]["n_a"] > 0 and rows[5][0]["n_links"] == 0


def test_learned_operators(docs, labels):
    good = of(quality_classifier.score(docs.drop("quality"), quality_classifier.train(docs, labels)), "quality.score")
    assert all(0 <= s <= 1 for s, in good.values())
    grades = of(toxicity.grade(docs.drop("toxicity"), toxicity.fit(docs, labels)), "toxicity.severity")
    assert len(grades) == len(ROWS)
    language = of(language_id.identify(docs.drop("language"), language_id.train(docs)), "language.lang")
    assert language[1] == ("en",) and language[4] == language[5] == ("und",)


def test_copies(docs):
    got = of(simhash.near_duplicates(docs), "component_id")
    assert got[1] == got[2] == (1,) and got[3] == (3,) and got[4] == got[5] == (4,)
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == {1, 3, 4, 6}
    cut = of(substring_dedup.remove_repeated(docs), "n_words", "n_removed")
    assert cut[1] == (N + 3, N + 3) and cut[3] == (2, 0) and cut[6] == (1, 0) and cut[4] == cut[5] == (0, 0)


def test_benchmark_passage_at_the_end(docs, spark):
    items = spark.createDataFrame([("q", " ".join(LONG.split()[-40:-4])), ("none", None), ("empty", "")], "item_id string, text string")
    hits = {r.key: r for r in decontamination.contamination(docs, items).collect()}
    assert len(hits) == 2 and all(r.n_hit == 36 and r["items"] == ["q"] for r in hits.values())
    assert {r.doc_id for r in decontamination.decontaminate(docs, items).collect()} == {1, 2, 3, 4, 5, 6}


def test_pieces(docs):
    got = of(sentencepiece_nbest.encode(docs.drop("segmentations"), n=2), "segmentations")
    assert len(got[1][0]) == 2 and got[4] == got[5]


def test_empty_tables(docs, labels, spark):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id string, text string")
    for df in (quality_rules.ledger(none), secrets.scan(none, secrets.learn(none)), secrets.redact(none, secrets.learn(none)),
               token_counts.count_tokens(none), quality_classifier.score(none, quality_classifier.train(none, labels)),
               toxicity.grade(none, toxicity.fit(none, labels)), language_id.identify(none, language_id.train(none)),
               simhash.near_duplicates(none), simhash.deduplicate(none), substring_dedup.remove_repeated(none),
               decontamination.decontaminate(none, items), sentencepiece_nbest.encode(none), token_alignment.alignment(none)):
        assert df.count() == 0
    assert decontamination.decontaminate(docs, items).count() == len(ROWS)
