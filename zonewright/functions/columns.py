"""Column helpers: safe names, the mask, the cast and the null-safe comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how the column holding the hash of x is called, masked_x.
MASK_PREFIX = "masked_"


def quote(name: str) -> str:
    """Backtick a top-level column name so dots in it are not read as nesting."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def name_folding(df: DataFrame) -> Callable[[str], str]:
    """How the session compares column names: as they are, or without regard to case."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return str if exact else str.lower


def masked_name(name: str) -> str:
    return MASK_PREFIX + name


def sha256_hex(column: Column, data_type: T.DataType, salt: str | None = None) -> Column:
    """Lower-case hex SHA-256 of a string or binary column; NULL stays NULL.

    Other atomic types are hashed through their string form. Nested types have no
    canonical text and are refused.
    """
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"cannot mask a column of type {data_type.simpleString()}")
    if isinstance(data_type, T.BinaryType):
        value = column if salt is None else F.concat(F.lit(salt).cast("binary"), column)
    else:
        text = column if isinstance(data_type, T.StringType) else as_text(column, data_type)
        value = text if salt is None else F.concat(F.lit(salt), text)
    return F.sha2(value, 256)


def as_text(column: Column, data_type: T.DataType) -> Column:
    """An atomic value as text. An instant is written in UTC, whatever the session's zone."""
    if not isinstance(data_type, T.TimestampType):
        return column.cast("string")
    seconds = (F.unix_micros(column).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return (epoch + F.make_dt_interval(secs=seconds)).cast("string")


def all_same(left: list[Column], right: list[Column]) -> Column:
    """True when the two lists are pairwise equal, NULL counting as equal to NULL."""
    return reduce(lambda a, b: a & b, (a.eqNullSafe(b) for a, b in zip(left, right, strict=True)))


def refuse_reserved(*tables: DataFrame) -> None:
    """Names beginning with two underscores are those of helper columns."""
    taken = [c for df in tables for c in df.columns if c.startswith("__")]
    if taken:
        raise ValueError(f"reserved column names: {taken}")


def require(ok: Column, message: str) -> Column:
    """A filter condition: true where ``ok`` holds, else the query fails with ``message``."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
