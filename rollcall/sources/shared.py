"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/rollcall-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    files, path = _at(spark, path)
    return files.exists(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder; none is no fault."""
    files, path = _at(spark, path)
    files.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: whatever reads it sees the same rows."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (counted); else as it is, and the join is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
