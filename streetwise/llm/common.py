"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one long that may be broadcast: 2 million are about 32 MB in a hash relation.
BROADCAST_ROWS = 2_000_000
#: Bytes of fixed-width rows, with what a hash relation adds, that may be broadcast.
BROADCAST_BYTES = 64_000_000
#: Bytes of rows that are sent to a Python worker in one go (a longer row is sent alone).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is
    unset, a temporary folder if driver and executor are one process; a cluster has to
    name one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = found.get() if found.isDefined() else None
    if not set_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="streetwise-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch for Python workers in this session: with texts of some
    KB the engine's own bound holds tens of MB a task, on both sides. A lower bound that
    is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(name))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def heap_given_back(spark: SparkSession) -> None:
    """Has the executors collect their garbage and so give heap that is free back to the
    machine: without, a heap stays as large as earlier work has made it, beside the Python
    workers of later work. As many short tasks as cores, so that idle executors all get
    one; an executor that gets none keeps its heap, and no result depends on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, which have columns of fixed width, surely fit:
    BROADCAST_BYTES with 40 bytes a row for the hash relation. ``df`` is counted, so it
    should be a checkpoint or a file."""
    width = 40 + sum(_width(f.dataType) for f in df.schema.fields)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _width(kind: T.DataType) -> int:
    return 16 + sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 20 if isinstance(kind, T.StringType) else 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
