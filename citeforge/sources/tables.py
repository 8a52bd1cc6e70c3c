"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Unset, only a local master has one of its own: there all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def dropped_at_end(spark: SparkSession, path: str) -> None:
    """Removes the folder when the JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table under spark.checkpoint.dir, read again.

    Several branches read it without working it out again, the plan above it starts small, and a
    lost executor loses nothing. The table goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
