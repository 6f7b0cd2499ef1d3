"""Corpus preparation: five stages over ``documents``, each an operator of
``meterframe.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``.

1. quality: documents that the learned classifier rejects go;
2. near duplicates: one document of each class of SimHash near copies stays
   (three-word shingles, fingerprints at most two bits apart);
3. benchmark: documents with a twentieth or more of their words inside
   benchmark windows go;
4. secrets: found credentials are replaced in the text;
5. pieces: every document is encoded into vocabulary pieces (ids of the best
   segmentation, its score and those of the next best).

Defined results: NULL and empty texts pass the stages as empty texts (near
duplicates of each other); NULLs and extra columns are kept as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm import decontamination, quality_classifier, secrets, sentencepiece_nbest, simhash
from meterframe.llm.frames import free_name, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality")
    return quality_classifier.score(docs, model).where(F.col(f"`{name}`.predicted") == 1).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; credentials in its text become ``[SECRET]``.
    ``n_chars``, if there is one, follows the new text."""
    clean = secrets.redact(docs, secrets.learn(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the two best segmentations: number of
    pieces, score and ids of the best one, score of the next."""
    best = sentencepiece_nbest.encode(docs.select("doc_id", "lang", "source", "text"), n=2)
    at = lambda i, what: F.get("segmentations", F.lit(i))[what]
    return best.select("doc_id", "lang", "source", (F.octet_length(at(0, "ids")) / 4).cast("long").alias("n_pieces"),
                       at(0, "score").alias("score"), at(1, "score").alias("next_score"), at(0, "ids").alias("ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_scan),
    ("pieces", pieces),
]

#: No stage-by-stage SQL: the classifier, the fingerprints and the automata have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
