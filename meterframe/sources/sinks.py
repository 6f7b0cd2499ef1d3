"""Writers (S6-S8, S12, S13, S14).

Data sets are written by the executors (Parquet / CSV).  Only the metadata
document, a bounded JSON text, is written from the driver, through the Hadoop
file system API so that it lands on the same shared storage as the data.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import with_calendar
from ..operators.panel import sort_by_series
from ..operators.reshape import long_to_blocks
from ..schema import CLIENT, SPLIT, TS, Y
from ..session import checkpoint_dir, stored


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Partitioned data set; only the partitions that ``df`` has rows of are
    replaced, so a phase or model that is run again leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


BLOCK_SIZE = 256           # series of a column block


def number_series(clients: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(client_id, ordinal, block, place): the series in order of their names,
    dealt into blocks.  Names are dealt out by range, numbered inside the
    ranges, and the ranges' sizes added up: no task holds all names."""
    ids = clients.select(CLIENT).where(F.col(CLIENT).isNotNull()).distinct()
    ids = stored(ids.repartitionByRange(CLIENT).select(CLIENT, F.spark_partition_id().alias("_r")), "names")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)          # one row per range
    sizes = ids.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    at = F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy(CLIENT)) - 1
    return ids.join(sizes, "_r").select(CLIENT, at.cast("long").alias("ordinal")) \
        .select("*", F.floor(F.col("ordinal") / block_size).cast("int").alias("block"),
                (F.col("ordinal") % block_size).cast("int").alias("place"))


def write_master_blocks(hourly_long: DataFrame, clients: DataFrame, path: str, block_size: int = BLOCK_SIZE,
                        by: tuple[str, ...] = ()) -> None:
    """The wide hourly master in column blocks: ``values`` has a row per
    hour and block, ``cells`` being the values of its series in order (clustered
    and sorted by block, so that a reader of one block skips the other files);
    ``manifest`` says which series stands at which place.  However many
    series there are, plan and schema stay the same.  ``by`` names further
    partition columns (e.g. the split)."""
    numbers = stored(number_series(clients, block_size), "numbers")
    numbers.orderBy("ordinal").write.mode("overwrite").parquet(f"{path}/manifest")
    parts = long_to_blocks(hourly_long, numbers.select(CLIENT, "block", "place"), block_size, by=by).withColumnRenamed(TS, "timestamp")
    # a block lies in one file; a folder for each block would mean as many files as blocks, times tasks
    parts.repartition(*by, "block").sortWithinPartitions(*by, "block", "timestamp") \
        .write.mode("overwrite").partitionBy(*by).parquet(f"{path}/values")


HOURS_PER_FILE = 168       # hours of a file of the wide table


@contextmanager
def interpreted(spark: SparkSession):
    """Projections of the block run as they are, without generated code: for a row of as
    many fields as there are series the code grows with the panel, and executors
    have to compile it."""
    key = "spark.sql.codegen.factoryMode"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "NO_CODEGEN")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_master_wide(hourly_long: DataFrame, clients: list[str], path: str) -> None:
    """Wide hourly master, ``timestamp`` + one column per series in the
    given order, put together from column blocks.  Whether a panel is written
    wide, in blocks or long is the caller's choice, never a matter of its size.

    The blocks are stored first, so that only rows of one file's hours are put
    together in a task.  A file holds about a week: each has a writer and a footer
    entry per column.  No dictionaries: each would take its buffers in
    every column, however few values a week has."""
    spark = hourly_long.sparkSession
    names = F.lit("\x1f".join(clients))
    numbers = spark.range(1).select(F.posexplode(F.split(names, "\x1f")).alias("_i", CLIENT)).select(
        CLIENT, F.floor(F.col("_i") / BLOCK_SIZE).cast("int").alias("block"), (F.col("_i") % BLOCK_SIZE).cast("int").alias("place"))
    kind = hourly_long.schema[Y].dataType.simpleString()
    blocks = stored(long_to_blocks(hourly_long, numbers, BLOCK_SIZE), "wide-blocks")
    files = blocks.select(TS).distinct().count() // HOURS_PER_FILE + 1
    rows = blocks.repartitionByRange(files, TS).groupBy(TS).agg(F.map_from_entries(F.collect_list(F.struct("block", "cells"))).alias("_m"))
    none = F.array_repeat(F.lit(None).cast(kind), BLOCK_SIZE)
    last = max(0, -(-len(clients) // BLOCK_SIZE) - 1)
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda b: F.coalesce(F.try_element_at("_m", b), none)))
    wide = rows.select(F.col(TS).alias("timestamp"), cells.alias("_c"))
    # one statement: a call for each column takes minutes for 50,000
    listed = ", ".join(["timestamp", *(f"get(_c, {i})" for i in range(len(clients)))])
    with interpreted(spark):
        spark.sql(f"select {listed} from {{wide}}", wide=wide).toDF("timestamp", *clients) \
            .write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(path)


def write_wide_text(hourly_long: DataFrame, clients: DataFrame, path: str, sep: str = ";") -> str:
    """The panel as delimited text lines without header, one line per hour;
    returns the header line, which ``read_wide_text`` takes."""
    numbers = stored(number_series(clients), "numbers")
    names = [r[0] for r in numbers.orderBy("ordinal").select(CLIENT).toLocalIterator()]      # the header of the text asked for
    blocks = long_to_blocks(hourly_long.withColumn(Y, F.col(Y).cast("string")), numbers.select(CLIENT, "block", "place"), BLOCK_SIZE)
    rows = blocks.groupBy(TS).agg(F.map_from_entries(F.collect_list(F.struct("block", "cells"))).alias("_m"))
    none = F.array_repeat(F.lit(None).cast("string"), BLOCK_SIZE)
    last = max(0, -(-len(names) // BLOCK_SIZE) - 1)
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda b: F.coalesce(F.try_element_at("_m", b), none)))
    line = F.concat_ws(sep, F.date_format(F.col(TS), "yyyy-MM-dd HH:mm:ss"),
                       F.array_join(F.slice(cells, 1, max(1, len(names))), sep, ""))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
    return sep.join(["", *names])


def write_calendar(spine: DataFrame, path: str) -> None:
    """The calendar columns of every hour, CSV with header."""
    with_calendar(spine.select(F.col(TS).alias("timestamp")), "timestamp").orderBy("timestamp") \
        .write.mode("overwrite").option("header", True).csv(path)


def write_master_long(hourly_long: DataFrame, path: str) -> None:
    """Long master: clustered by series so readers of one series touch few
    files."""
    sort_by_series(hourly_long).write.mode("overwrite").parquet(path)


def write_master_bucketed(hourly_long: DataFrame, table: str, buckets: int) -> None:
    """Long master as a table bucketed by series and sorted by (series, time)
    within each bucket.  Later per-series work on it -- lookback windows,
    per-series statistics, joins on the series key with another table of the
    same bucketing -- reads co-partitioned data and needs no shuffle.
    ``buckets`` should give files of a few hundred MB."""
    (hourly_long.write.mode("overwrite").bucketBy(buckets, CLIENT).sortBy(CLIENT, TS)
     .saveAsTable(table))


def write_aggregate(agg: DataFrame, path: str | None) -> None:
    """The summed series; skipped when no path is configured."""
    if path:
        agg.withColumnRenamed(TS, "timestamp").write.mode("overwrite").parquet(path)


def write_client_list(clients: DataFrame, path: str) -> None:
    """``client_id`` CSV with header, sorted."""
    (clients.select(CLIENT).distinct().orderBy(CLIENT)
     .write.mode("overwrite").option("header", True).csv(path))


def write_splits(panel_with_split: DataFrame, path: str) -> None:
    """One long data set partitioned by ``split``; readers of one split
    get partition pruning."""
    panel_with_split.write.mode("overwrite").partitionBy(SPLIT).parquet(path)


def write_split_exports(panel_with_split: DataFrame, clients: DataFrame, base: str) -> None:
    """The split panel as one long data set partitioned by ``split``, and in
    column blocks, partitioned by split and block (one manifest for all)."""
    write_splits(panel_with_split, f"{base}/long")
    write_master_blocks(panel_with_split, clients, f"{base}/wide", by=(SPLIT,))


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file through the Hadoop FS API (any scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    parent = p.getParent()
    if parent is not None and not fs.exists(parent):
        fs.mkdirs(parent)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text_file(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def write_metadata(spark: SparkSession, doc: dict, path: str, lists: dict[str, DataFrame] | None = None) -> None:
    """The metadata document, UTF-8 JSON, indented.

    ``lists`` holds the per-series entries of the document: for a key of ``doc``
    a DataFrame of ids, or of (id, text) for an object.  Executors write them as
    ordered text parts, and the parts are copied into the document stream to
    stream; no row of theirs becomes an object of the driver.  The text is the
    same as that of a document dumped as a whole."""
    text = json.dumps({k: "\x00" + k if k in (lists or {}) else v for k, v in doc.items()}, ensure_ascii=False, indent=2)
    if not lists:
        write_text_file(spark, path, text)
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    target = of(path)
    fs = target.getFileSystem(conf)
    parts = {}
    for key, rows in lists.items():
        parts[key] = f"{checkpoint_dir(spark)}/metadata-{uuid.uuid4().hex}"
        quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
        name = rows.columns[0]
        last = rows.agg(F.max(name)).first()[0]
        entry = F.concat_ws(": ", *[F.when(F.col(c).isNull(), "null").otherwise(quoted(f"`{c}`")) for c in rows.columns])
        comma = F.when(F.col(name) == F.lit(last), "").otherwise(",")
        rows.orderBy(name).select(F.concat(F.lit("    "), entry, comma).alias("value")).write.text(parts[key])
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    out = fs.create(target, True)
    copy = jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        pieces = re.split(r'"\\u0000(\w+)"', text)
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                out.write(bytearray(piece.encode("utf-8")))
                continue
            is_object = len(lists[piece].columns) > 1
            folder = of(parts[piece])
            store = folder.getFileSystem(conf)
            files = sorted(str(f.getPath().toString()) for f in store.listStatus(folder)
                           if f.getPath().getName().startswith("part-") and f.getLen() > 0)
            out.write(bytearray(("{" if is_object else "[").encode() + (b"\n" if files else b"")))
            for f in files:
                source = store.open(of(f))
                try:
                    copy(source, out, 1 << 16, False)
                finally:
                    source.close()
            out.write(bytearray((b"  " if files else b"") + ("}" if is_object else "]").encode()))
    finally:
        out.close()


def write_model_table(params: DataFrame, path: str) -> None:
    """The typed model table of one model, keyed by client_id (and phase,
    if there is one).  Each model has its own columns and its own data set."""
    by = [c for c in ("phase",) if c in params.columns]
    if by:
        write_partitions(params, path, *by)
    else:
        params.write.mode("overwrite").parquet(path)


def read_model_table(spark: SparkSession, path: str) -> DataFrame | None:
    """S14 reload; a missing table is reported (None), not fatal."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)
