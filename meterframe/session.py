"""Spark session helpers.

Library code never creates a session itself; jobs, tests and the bench call
:func:`local_session`.  On a cluster the session comes from ``spark-submit``
and only :func:`checkpoint_dir` is consulted.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours relies on.  Session time zone UTC keeps the
# TIMESTAMP <-> TIMESTAMP_NTZ casts that some built-ins force (date_trunc,
# to_utc_timestamp) free of local-time gaps.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "meterframe", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # checkpoint files are removed once their DataFrame is gone
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", os.environ.get("METERFRAME_DRIVER_MEM", "8g")))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in BASE_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def job_session(app: str) -> SparkSession:
    """Session of a launched job: master and resources as configured by
    spark-submit, our settings on top, the package shipped to the executors."""
    builder = SparkSession.builder.appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship_package(spark)
    checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors, so that Python workers import it
    wherever the job was started from."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="meterframe-ship-")) / "meterframe.zip"   # on the driver only
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``.  Only when it is unset on a
    ``local[...]`` master (local runs and tests) a fresh folder under the
    system temp dir is taken; on a cluster an unset folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if sc.master != "local" and not sc.master.startswith("local["):   # local-cluster[...] has several machines
        raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage "
                           "(a machine-local folder does not survive the loss of an executor)")
    local = tempfile.mkdtemp(prefix="meterframe-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back:
    the lineage is cut, and readers still get column and partition pruning."""
    path = f"{checkpoint_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TARGET_SHUFFLE_BYTES = 128 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the input files, from file-system metadata (no scan)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        for st in fs.globStatus(p) or []:
            total += fs.getContentSummary(st.getPath()).getLength()
    return int(total)


def size_shuffles(spark: SparkSession, paths: list[str], expansion: float = 1.0,
                  lo: int = 8) -> int:
    """Set the number of shuffle partitions from the input size so that a
    partition holds about ``TARGET_SHUFFLE_BYTES`` (adaptive execution then
    merges the small ones).  ``expansion`` accounts for operators that widen
    the data (e.g. wide -> long).  A value the user set explicitly wins."""
    if spark.conf.get("spark.meterframe.shufflePartitions.fixed", "false") == "true":
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = int(input_bytes(spark, paths) * expansion // TARGET_SHUFFLE_BYTES) + 1
    n = max(lo, n)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n
