"""Measured sizes, to decide on a broadcast from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.columns import col

BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together stay below ``max_bytes``, counted over the data itself.

    A row counts 16 bytes per column plus the length of its text. Nested columns are not
    measured, so a table holding one never counts as small.
    """
    row = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return False
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(col(f.name)), F.lit(0))
    return (df.agg(F.sum(row)).first()[0] or 0) <= max_bytes
