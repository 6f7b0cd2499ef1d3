"""Registered queries and the pipeline on the smallest tables."""

import duckdb
import numpy as np
import pytest
from test_matching import classes, contaminated, fingerprint, kept

import corpus_pipeline
from meterframe.llm import quality_classifier, queries, secrets, sentencepiece_nbest
from meterframe.llm.frames import documents, table

SF = "/root/testdata/sf0.001"
TEXTS = {r[0]: r[1] for r in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


def test_thirteen_queries_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == \
        sorted(map(str, want.project(", ".join(order)).fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op12_nearest_neighbours"}))
def test_query_answers_every_document(spark, name):
    got = queries.queries()[name](spark, SF)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(TEXTS)
    if name.startswith("op7"):
        _, group = classes(TEXTS)
        assert {r.doc_id: r.component_id for r in rows} == group
        assert all(int(r.fingerprint, 16) == fingerprint(TEXTS[r.doc_id]) for r in rows)
    if name.startswith("op9"):
        assert all(r.decoded and r.score_1 >= r.score_2 >= r.score_3 for r in rows)
    if name.startswith(("op3", "op5", "op10")):
        assert {type(r.held_out) for r in rows} == {bool}


def test_substring_query_keeps_what_brute_force_keeps(spark):
    ids = sorted(TEXTS)
    want = {i: x[:2] for i, x in zip(ids, kept([TEXTS[i] for i in ids], 35), strict=True)}
    got = queries.op8_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == want


def test_pipeline_equals_brute_force_after_the_classifier(spark):
    model = quality_classifier.train(documents(spark, SF), table(spark, SF, "labels"))
    good = [r.doc_id for r in quality_classifier.score(documents(spark, SF), model)
            .where("quality.predicted = 1").select("doc_id").collect()]
    texts = {i: TEXTS[i] for i in good}
    texts = {i: texts[i] for i in set(classes(texts)[1].values())}
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    texts = {i: texts[i] for i, (n, h, _) in contaminated(texts, items).items() if not (h and 20 * h >= n)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redact(frame, secrets.learn(frame)).collect()}
    for i, t in texts.items():
        base = secrets.base_spans(t)
        assert (clean[i] == t) if not base else ("[SECRET]" in clean[i] and all(v not in clean[i] for *_, v in base))
    lattice = sentencepiece_nbest.Lattice(sentencepiece_nbest.model_pieces())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: lattice.decode(np.frombuffer(r.ids, "<i4").tolist()) for r in got} == clean
    assert len(got) == len(clean)


def test_stages_keep_the_columns_and_take_anything(spark):
    odd = spark.createDataFrame(
        [(1, None, "en", None, 0, "x"), (None, "", None, "s", None, "y"), (2, "a b", "en", "s", 3, None),
         (2, "a b", "en", "s", 3, None), (3, "token = abcdefgh1234", "de", "s", 20, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, quality string")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "pieces" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
