"""Joins in which single keys hold much of one side.

Frequent keys are found by a Misra-Gries summary per task (Spark's frequent-items sketch), merged
in two steps, so that no task receives a summary from every other. Only the rows of those keys get
a salt, and only their partners on the other side are repeated per salt: every other row is
shuffled once, by its key, as in a plain join. This works without adaptive execution, and where
that cannot split a partition: a side that is not a plain exchange, or the right side of a left
join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col

#: Counters of a summary; a count is off by at most 3.5 / COUNTERS of the rows.
COUNTERS = 1024
_MERGERS = 64
_SALT = "__salt"
_WAYS = ("inner", "left", "left_semi", "left_anti")


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[col(k) for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> dict[int, int]:
    """Hashes of the keys that hold more than ``share`` of the rows without a NULL key, each with
    the number of pieces of that share its rows make. At most 1 / ``share`` of them; a pass over
    the key columns."""
    if not 4 / COUNTERS < share < 1:
        raise ValueError(f"share must lie between {4 / COUNTERS} and 1")
    most = int(1 / share) + 1  # no more keys can hold that much
    counters = F.lit(COUNTERS)
    whole = df.where(reduce(and_, [col(k).isNotNull() for k in keys])).select(_hash(keys).alias("h"))
    parts = whole.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGERS)).alias("p")).agg(
        F.call_function("approx_top_k_accumulate", F.col("h"), counters).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    # grouped, as there is no combining of nothing
    merged = parts.groupBy(F.pmod("p", F.lit(1))).agg(
        F.call_function("approx_top_k_combine", F.col("s"), counters).alias("s"), F.sum("n").alias("n")
    )
    row = merged.select(F.call_function("approx_top_k_estimate", F.col("s"), F.lit(most)).alias("top"), "n").first()
    if row is None:
        return {}
    limit = share * row.n
    return {t["item"]: -int(-t["count"] // limit) for t in row.top if t["count"] > limit}


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    heavy: Mapping[int, int] | None = None,
    share: float = 0.01,
    also: Column | None = None,
) -> DataFrame:
    """``left.join(right, on, how)`` with the rows of ``left`` under a frequent key spread over
    several tasks. ``heavy`` comes from ``heavy_keys`` on the left side, which is called unless
    it is given.

    The salt of a row comes from its values and its task, so equal rows of different tasks part
    too, and a task that runs again deals its rows as before. Rows of ``right`` under a frequent
    key are repeated as often as it has pieces, so they should be few. NULL keys match nothing.
    ``also`` is a further condition on columns of both sides, whose names must differ.
    """
    if how not in _WAYS:
        raise ValueError(f"cannot spread a {how} join, expected one of {_WAYS}")
    if _SALT in (*left.columns, *right.columns):
        raise ValueError(f"reserved column name: {_SALT}")
    heavy = heavy_keys(left, on, share) if heavy is None else heavy
    pieces = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair]) if heavy else None
    own = F.coalesce(F.element_at(pieces, _hash(on)), F.lit(1)) if heavy else None
    if heavy:
        others = [col(c) for c in left.columns if left.schema[c].dataType.typeName() not in ("map", "variant")]
        dealt = F.xxhash64(F.spark_partition_id(), *others)
        left = left.withColumn(_SALT, F.pmod(dealt, own).cast("int"))
        right = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), own - 1)))
        on = [*on, _SALT]
    if also is None:
        return left.join(right, list(on), how).drop(_SALT)
    theirs = {k: f"__of_{k}" for k in on}
    same = [col(k) == col(v) for k, v in theirs.items()]
    joined = left.join(right.withColumnsRenamed(theirs), reduce(and_, same) & also, how)
    return joined.drop(_SALT, *theirs.values())
