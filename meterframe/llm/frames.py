"""Small helpers that the text operators share.

Conventions of every operator in this package:

* A document is a row with ``doc_id`` and ``text``; other columns are ignored
  or passed through.  Columns an operator adds for itself get names that the
  input does not use (:func:`free_name`), so clashing names are harmless.
* NULL text counts as an empty text.  NULL ``doc_id`` is a value like any
  other; rows that repeat another row are answered row by row.
* Operators that need more than one pass identify a row by ``doc_id`` and
  ``xxhash64(text)`` (:func:`row_key`): two rows that share a ``doc_id`` but
  not the text stay apart.
* Intermediate results that are read again are Parquet files in the shared
  folder ``spark.checkpoint.dir``; a lost executor repeats one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores appended as it takes to be new in ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """``doc_id`` and text hash as one string that is never NULL, so that it
    serves plain equi-joins."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.lit("/"), text_hash(text).cast("string"))


def key_of(doc_id: str, hash_col: str) -> Column:
    """:func:`row_key` from an id and a text hash already computed."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.lit("/"), F.col(hash_col).cast("string"))


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of ``doc_id`` as text; a NULL id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def unsigned_hex(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, y, text) of at most ``limit`` labelled documents, those whose
    ids have the smallest hashes.  Of several labels of a document the larger
    one counts, of several texts one."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    keep = docs.select("doc_id").distinct().join(one, "doc_id") \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(keep, "doc_id") \
        .groupBy("doc_id", "y").agg(F.min("text").alias("text"))
