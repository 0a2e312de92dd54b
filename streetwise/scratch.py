"""Tables that a run keeps for a while, in the folder that driver and executors share.

Written and read again, a table has a short plan and known sizes: what is built on
it is planned in no time, and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only if all of Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="streetwise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Keeps tables until close()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete(self.spark, self.folder)


def held(df: DataFrame, scratch: Scratch | None) -> DataFrame:
    """Kept in ``scratch``, or without one as a checkpoint, which Spark may clean up when nothing uses it any more."""
    if scratch is not None:
        return scratch.keep(df)
    context = df.sparkSession.sparkContext
    where = shared_dir(df.sparkSession)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)
