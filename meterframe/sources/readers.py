"""Readers producing the canonical long readings table
``(client_id STRING, ts TIMESTAMP_NTZ, y FLOAT)`` (S1-S4, S9-S11)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import lenient_float, lenient_timestamp, nan_to_null
from ..schema import CLIENT, TS, Y


def read_wide_text(spark: SparkSession, path: str, sep: str = ";",
                   decimal: str = ",", header: str | None = None) -> DataFrame:
    """A delimited wide file (first column = time, one column per
    series) -> long readings.

    Lines are split where they are read and their cells exploded at once, next to
    the header as one array, so the plan is as small for 50,000 series as for
    three.  The first cell becomes ``ts`` whatever its header (S2); rows whose
    time does not parse are dropped (S3), header lines of further files among
    them; each cell is parsed on its own, bad and absent cells become NULL
    (S4), cells beyond the header are dropped.  With ``decimal=","`` a comma
    is the decimal mark; a point is accepted too (deviation T2).  Quotes
    around a cell are removed; a separator inside quotes is not supported.

    ``header`` is the header line, by default the file's first line; an empty
    file has no readings."""
    lines = spark.read.text(path)
    if header is None:
        first = lines.first()                                          # one line
        header = first[0] if first else ""
    by = re.escape(sep)
    bare = lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")
    listed = [re.sub('^"|"$', "", x.strip()) for x in header.split(sep)]
    n, names = len(listed), F.split(F.lit("\x1f".join(listed)), "\x1f")   # a constant array
    cells = F.slice(F.split("value", by, n + 1), 1, n)
    lines = lines.select(lenient_timestamp(bare(F.get(cells, F.lit(0)))).alias(TS), cells.alias("_cells")) \
        .where(F.col(TS).isNotNull())
    padded = F.concat("_cells", F.array_repeat(F.lit(None).cast("string"), F.lit(n) - F.size("_cells")))
    long = lines.select(TS, F.posexplode(padded).alias("_i", "_txt")).where("_i > 0")
    txt = bare(F.col("_txt"))
    if decimal != ",":
        # a comma is not a decimal mark here: such cells stay unparseable
        txt = F.when(~F.col("_txt").contains(","), txt)
    return long.select(F.get(names, F.col("_i")).alias(CLIENT), TS, lenient_float(txt).alias(Y))


def read_master_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The wide master in column blocks (see ``sinks.write_master_blocks``) as long readings."""
    blocks, names = spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/manifest")
    cells = blocks.select(F.col("block").cast("int").alias("block"), F.col("timestamp").alias(TS),
                          F.posexplode("cells").alias("place", Y))
    return cells.join(names, ["block", "place"]).select(CLIENT, TS, Y)


def read_metadata_entries(spark: SparkSession, path: str) -> DataFrame:
    """The per-series entries of a metadata document (see ``sinks.write_metadata``),
    one row each: ``keyed`` (entry of an object, else of a list), ``name`` and
    ``value`` (NULL in lists).  Each entry is a line of its own, so the lines
    are read and parsed apart, wherever the document is split."""
    entry = F.regexp_replace(F.regexp_extract("value", "^    (.*)$", 1), ",$", "")
    rows = spark.read.text(path).where(F.col("value").startswith("    ")).select(
        entry.alias("entry"), (~entry.rlike(r'^(?:"(?:[^"\\]|\\.)*+"|null)$')).alias("keyed"))
    pair = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), "map<string, string>")
    item = F.from_json(F.concat(F.lit("["), "entry", F.lit("]")), "array<string>")
    return rows.select("keyed", F.when(F.col("keyed"), F.map_keys(pair)[0]).otherwise(item[0]).alias("name"),
                       F.when(F.col("keyed"), F.map_values(pair)[0]).alias("value"))


def readings_from_table(df: DataFrame, client: str, ts: str, value: str) -> DataFrame:
    """Map any table onto the readings schema: id as text, time as
    TIMESTAMP_NTZ, value as FLOAT with NaN -> NULL."""
    return df.select(F.col(client).cast("string").alias(CLIENT),
                     F.col(ts).cast("timestamp_ntz").alias(TS),
                     nan_to_null(F.col(value).cast("float")).alias(Y))


def read_long_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long panel CSV with header ``timestamp, client_id, y``."""
    df = (spark.read.option("header", True)
          .schema("timestamp timestamp_ntz, client_id string, y float").csv(path))
    return df.select(F.col("client_id").alias(CLIENT), F.col("timestamp").alias(TS),
                     nan_to_null(F.col("y")).alias(Y))


WIDE_GROUP = 4096          # columns of a wide table that are read together


def read_wide_cells(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """The wide hourly master (Parquet) as (ts, ordinal, client_id, y): one row per hour and
    column, missing cells too, ``ordinal`` being the column's place, from 1.  Columns
    are read in groups, each by a scan of its own columns: a reader has buffers for each
    column, and no task holds those of all."""
    schema = spark.read.parquet(path).schema
    fields = {f.name: f for f in schema}
    time = "timestamp" if "timestamp" in fields else TS
    cols = [c for c in schema.names if c != time and c.startswith(prefix or "")]
    parts = []
    for at in range(0, max(1, len(cols)), WIDE_GROUP):
        some = cols[at:at + WIDE_GROUP]
        group = spark.read.schema(StructType([fields[c] for c in (time, *some)])).parquet(path) \
            .toDF(TS, *(f"_{i}" for i in range(len(some))))
        array = F.expr(f"array({', '.join(group.columns[1:])})" if some else "cast(array() as array<double>)")
        listed = F.split(F.lit("\x1f".join(some)), "\x1f")
        parts.append(group.select(TS, F.posexplode(array).alias("_i", Y)).select(
            TS, (F.col("_i") + (at + 1)).alias("ordinal"), F.get(listed, F.col("_i")).alias(CLIENT), Y))
    while len(parts) > 1:                                    # in pairs: a shallow plan
        parts = [a.unionAll(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return parts[0]


def read_master_wide(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """S9 + R1: the wide hourly master (Parquet) as long readings."""
    return read_wide_cells(spark, path, prefix).select(CLIENT, TS, F.col(Y).cast("float").alias(Y))


def client_ids(df: DataFrame) -> DataFrame:
    """The series ids only; Catalyst prunes the scan to one column."""
    return df.select(CLIENT).distinct()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
