"""What the operators of this package share: reading tables, keeping tables, small checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.sources.scratch import scratch_dir

#: Text that a task turns into arrays at a time, in bytes; memory per task is a small multiple.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, no lineage behind it."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The columns that matter as (id long, text string) and ``more``; a null text is empty."""
    return docs.select(
        col(id_col).cast("long").alias("id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )


def chunks(ids: list, values: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """Lists of ids and values cut so that the values of a piece hold about ``limit`` units."""
    start = size = 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= limit:
            yield ids[start : i + 1], values[start : i + 1]
            start, size = i + 1, 0
    if start < len(values):
        yield ids[start:], values[start:]
