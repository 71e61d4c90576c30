"""Fingerprints of rows that add up: equal for equal bags of rows, in whatever order.

A fingerprint is a sum of 64-bit hashes as a decimal, so partial sums are taken in every task
and nothing but numbers is shuffled. NULL is a value of its own, all NaN are equal, and 0.0 and
-0.0 are equal, but for floating-point numbers inside arrays, maps and structs, which count as
they are written. It is a check against accidents, not against an adversary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.columns import col

#: Wide enough for 10^19 rows.
_SUM = "decimal(28,0)"


def _hashable(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        column, kind = F.array_sort(F.map_entries(column)), T.ArrayType(T.StringType())
    if isinstance(kind, (T.ArrayType, T.StructType)):
        # a hash passes over NULLs, so [NULL, 1] would be [1, NULL]
        return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return column


def value_hash(df: DataFrame, columns: Sequence[str], seed: int = 0) -> Column:
    """The 64-bit hash of a row's values in ``columns``, NULLs told apart by their place."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [x for c in columns for x in (col(c).isNull(), _hashable(col(c), kinds[c]))]
    return F.xxhash64(F.lit(seed), *parts)


def bag_print(hashed: Column) -> Column:
    """An aggregate: the fingerprint of all rows with this hash, 0 for none."""
    return F.coalesce(F.sum(hashed.cast(_SUM)), F.lit(0).cast(_SUM)).cast("string")


def table_print(df: DataFrame) -> str:
    """Rows and two fingerprints of a whole table, as one text; a pass over the data."""
    prints = [bag_print(value_hash(df, df.columns, seed)).alias(f"p{seed}") for seed in (1, 2)]
    n, *sums = df.agg(F.count(F.lit(1)).alias("n"), *prints).first()
    return "-".join(map(str, (n, *sums)))
