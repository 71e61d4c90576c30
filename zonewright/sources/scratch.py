"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``,
    deleted when the session's JVM ends. Without either it is an error, on any master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = f"{root.rstrip('/')}/zonewright-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a scratch table and read back, for a result that is returned: computed
    once, with no lineage behind it. The table goes when the session's JVM ends."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def materialized(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written once as a scratch table: it is computed once, outlives lost executors
    and has a size that can be measured. The table is deleted at the end of the block."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
