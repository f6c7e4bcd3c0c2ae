"""The folder that driver and executors share, and tables written there to cut the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a new one where it is unset, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpusweave-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written go as soon as it is written: it needs none behind it."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str = "cut", parts: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        (df if parts is None else df.coalesce(parts)).write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
