"""Cutting lineage where a result is read more than once.

Everything goes to the folder that the session names in spark.checkpoint.dir, which driver and
executors share, so it survives lost executors. A folder of our own is made only on one machine
(a local master) whose session names none, as in tests. Tables are removed when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data; an error on a cluster that names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cloakwork-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed with the driver's JVM."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete ``path`` now."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again: later readers see its size and prune its columns."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
