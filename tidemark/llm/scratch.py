"""Tables written to the shared scratch folder, to cut lineage or to read a result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only in local mode and where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder; what is written there goes when the session ends."""
    path = f"{folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it again; gone when freed, or when the session ends."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        at, files = _place(t.sparkSession, t._stored_at)
        files.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
