"""What the training-data operators share: the cluster's folder, row identity, and worker-side text helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches never exceed this many bytes, so very long texts can't pile up in a Python worker.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000
#: Up to so many ids (16 MB) are broadcast to meet larger rows; beyond it the rows are joined by id.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing (tests, a laptop), a folder under the warehouse is set as checkpoint folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/stratalog-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` below ``folder`` and read it back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_few(ids: DataFrame) -> DataFrame:
    """The stored ids, broadcast if there are few, so that what they meet needn't be shuffled with its texts or sets."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def only_kept(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete all tables below ``folder`` but those named, through Hadoop, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by bytes where this Spark can, and by rows."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as error:  # a Spark that lacks the setting, or fixes it at start
        if "CANNOT_MODIFY" not in str(error):
            raise


_kept: dict[str, dict] = {}


def trimmed() -> None:
    """Hand memory that this Python worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(spark: SparkSession) -> None:
    """Let executors hand heap that earlier stages filled back to the system, as Python workers need the memory beside it.

    A JVM that has little to allocate collects nothing and keeps all it once took. One short task for each core, of which
    idle executors get equally many; one that gets none, as other jobs run, keeps its heap, and no result depends on it.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected")
    spark.range(0, cores, 1, cores).select(collected).write.format("noop").mode("overwrite").save()


def memory_of(operator: str) -> dict:
    """What this Python worker keeps for ``operator`` between tasks.

    Workers outlive stages, so what they kept for any other operator goes first, and the freed memory back to the system.
    """
    others = [k for k in _kept if k != operator]
    for k in others:
        del _kept[k]
    if others:
        trimmed()
    return _kept.setdefault(operator, {})


def remainder_of_id(name: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a row."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(modulus)
