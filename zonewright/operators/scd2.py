"""The lookup table kept as a type-2 slowly changing dimension.

A row is one version of a business key. ``current`` (boolean) marks the open version,
``effectiveDate`` is when it was opened and ``updateDate`` when it was closed (NULL while
open). Comparisons are null-safe: a change to or from NULL is a change.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import (
    all_same,
    col,
    name_folding,
    quote,
    refuse_reserved,
    require,
)
from zonewright.operators.dictionary import as_date, key_of
from zonewright.operators.heavy import spread_join
from zonewright.sources.scratch import kept
from zonewright.sources.size import fits_broadcast

_DUPLICATE = "a business key occurs more than once in one side of the merge"
_LATE = "the merge is dated before the open version it would close"


def _tracked(columns: Sequence[str]) -> Column:
    return F.struct(*[col(c) for c in columns])


def scd2_open(batch: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Every row of ``batch`` as an open version."""
    return batch.select(
        "*",
        as_date(as_of).alias("effectiveDate"),
        F.lit(None).cast("date").alias("updateDate"),
        F.lit(True).alias("current"),
    )


def latest_per_key(
    batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """One row per key, the greatest by ``order_by``; the other columns break ties.

    A partial aggregate, so a key with many rows is reduced before the shuffle.
    """
    first = [c for c in order_by if c not in keys]
    rest = [c for c in batch.columns if c not in keys and c not in first]
    return (
        batch.groupBy(*[col(k) for k in keys])
        .agg(F.max(F.struct(*[col(c) for c in first + rest])).alias("__row"))
        .select(
            *[
                col(c) if c in keys else F.col(f"__row.{quote(c)}").alias(c)
                for c in batch.columns
            ]
        )
    )


def detect_changes(
    lookup: DataFrame, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str]
) -> DataFrame:
    """Batch rows whose key has an open version with different tracked values."""
    refuse_reserved(lookup, batch)
    names = [f"__key_{i}" for i in range(len(keys))]
    open_rows = lookup.where(F.col("current").cast("boolean")).select(
        *[col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        _tracked(tracked).alias("__tracked"),
    )
    differs = ~_tracked(tracked).eqNullSafe(F.col("__tracked"))
    # Null-safe only where a key may be NULL: a plain equality uses a partitioning by key that
    # is there already. Either way both sides are read once.
    nullable = [batch.schema[k].nullable for k in _as_named(batch, keys)]
    same_key = [
        col(k).eqNullSafe(F.col(n)) if null else col(k) == F.col(n)
        for k, n, null in zip(keys, names, nullable, strict=True)
    ]
    return batch.join(open_rows, reduce(and_, same_key) & differs, "left_semi")


def _as_named(df: DataFrame, names: Sequence[str]) -> list[str]:
    fold = name_folding(df)
    own = {fold(c): c for c in df.columns}
    return [own[fold(n)] for n in names]


def stage_updates(changed: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows to merge: ``changed`` with no merge key, so that a merge inserts them, and
    the whole batch with its key, so that a merge closes or inserts."""
    no_key = changed.select(F.lit(None).cast("string").alias("mergeKey"), "*")
    return no_key.unionByName(batch.select(key_of(keys).alias("mergeKey"), "*"))


def _seen(
    lookup: DataFrame, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str], as_of: dt.date | str
) -> DataFrame:
    """Both sides from one scan each, met in one exchange and one sort on the keys.

    Per key there are at most an open version (side 0) and a batch row (side 1), next to
    each other, so each row sees its peer with lead or lag. Grouping treats NULL keys as
    equal, which saves the second exchange of a null-safe join. A closed version (side -1) has a
    group of its own, told by its dates, so that a key with a long history is spread.
    """
    both = lookup.withColumn("__side", F.when(F.col("current"), 0).otherwise(-1)).unionByName(
        scd2_open(batch, as_of).withColumn("__side", F.lit(1))
    )
    is_closed = F.col("__side") == -1
    dates = F.xxhash64("effectiveDate", "updateDate", *[col(k) for k in keys])
    both = both.withColumn("__own", F.when(is_closed, dates))
    by_key = Window.partitionBy(*[col(k) for k in keys], "__own").orderBy("__side")
    is_stored = F.col("__side") == 0

    def peer(name: str) -> Column:
        return F.when(is_stored, F.lead(quote(name)).over(by_key)).otherwise(
            F.lag(quote(name)).over(by_key)
        )

    seen = both.select(
        "*",
        # Two rows of one side tie in rank but not in row number. Stated without __side, so
        # that no filter on it, pushed down from above, is folded into the check.
        (F.row_number().over(by_key) == F.rank().over(by_key)).alias("__once"),
        (peer("__side").isNotNull() & ~is_closed).alias("__paired"),
        # Column by column: a struct would travel through the exchange beside its parts.
        all_same([peer(c) for c in tracked], [col(c) for c in tracked]).alias("__same"),
    )
    changed = F.col("__paired") & ~F.col("__same")
    closing = is_stored & changed
    in_time = ~closing | F.coalesce(F.col("effectiveDate") <= as_date(as_of), F.lit(True))
    once = F.col("__once") | F.col("__own").isNotNull()
    return seen.where(require(once, _DUPLICATE) & require(in_time, _LATE)).withColumns(
        {
            "__new": (F.col("__side") == 1) & (~F.col("__paired") | changed),
            "__closing": closing,
        }
    )


def _closed(df: DataFrame, as_of: dt.date | str, closing: Column) -> DataFrame:
    """``df`` with the versions closed that are ``closing``."""
    return df.withColumns(
        {
            "updateDate": F.when(closing, as_date(as_of)).otherwise(F.col("updateDate")),
            "current": F.when(closing, F.lit(False)).otherwise(F.col("current")),
        }
    )


def _merge_shuffled(
    lookup: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    as_of: dt.date | str,
    only_changes: bool = False,
) -> DataFrame:
    wanted = F.col("__new") | (F.col("__closing") if only_changes else F.col("__side") < 1)
    seen = _seen(lookup, batch, keys, tracked, as_of).where(wanted)
    return _closed(seen, as_of, F.col("__closing")).select(*[col(c) for c in lookup.columns])


def _merge_broadcast(
    lookup: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    as_of: dt.date | str,
    only_changes: bool = False,
) -> DataFrame:
    """The batch goes to every task and the stored table is never shuffled; only open versions
    of keys in the batch are grouped, to see that a key has one of them and when it was opened.
    The batch and what it finds, a row per key of it at most, are stored, so that the result
    reads the table once."""
    counted = Window.partitionBy(*[col(k) for k in keys])
    batch = kept(
        batch.withColumn("__n", F.count(F.lit(1)).over(counted))
        .where(require(F.col("__n") == 1, _DUPLICATE))
        .drop("__n")
    )
    key_names = [f"__key_{i}" for i in range(len(keys))]
    named = [col(k).alias(n) for k, n in zip(keys, key_names, strict=True)]
    same_key = all_same([col(k) for k in keys], [F.col(n) for n in key_names])
    is_open = F.coalesce(F.col("current"), F.lit(False))

    small = F.broadcast(batch.select(*named, _tracked(tracked).alias("__tracked")))
    found = lookup.where(is_open).join(small, same_key).groupBy(*[F.col(n) for n in key_names])
    matches = found.agg(
        F.count(F.lit(1)).alias("__n"),
        F.bool_and(_tracked(tracked).eqNullSafe(F.col("__tracked"))).alias("__same"),
        F.max("effectiveDate").alias("__since"),
    )
    in_time = F.col("__same") | F.coalesce(F.col("__since") <= as_date(as_of), F.lit(True))
    checks = require(F.col("__n") == 1, _DUPLICATE) & require(in_time, _LATE)
    matches = kept(matches.where(checks).select(*[F.col(n) for n in key_names], "__same"))

    changed = F.broadcast(matches.where(~F.col("__same")))
    seen = lookup.join(changed, same_key & is_open, "inner" if only_changes else "left")
    stored = _closed(seen, as_of, F.col("__same").isNotNull())
    same = F.coalesce(F.col("__same"), F.lit(False))
    opened = batch.join(F.broadcast(matches), same_key, "left").where(~same)
    return stored.select(*[col(c) for c in lookup.columns]).unionByName(
        scd2_open(opened.select(*[col(c) for c in batch.columns]), as_of)
    )


def scd2_changes(
    lookup: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    as_of: dt.date | str,
    broadcast_batch: bool = False,
) -> DataFrame:
    """Only the rows that ``scd2_merge`` changes: the versions it closes, as they are afterwards,
    and those it opens. Refuses what the merge refuses."""
    refuse_reserved(lookup, batch)
    small = broadcast_batch and fits_broadcast(batch)
    merge = _merge_broadcast if small else _merge_shuffled
    return merge(lookup, batch, keys, tracked, as_of, only_changes=True)


def scd2_merge(
    lookup: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    as_of: dt.date | str,
    order_by: Sequence[str] = (),
    broadcast_batch: bool = False,
) -> DataFrame:
    """The whole history after merging ``batch`` into it.

    Changed keys have their open version closed and a new one opened, new keys get one,
    everything else is left alone. A key that occurs twice in the batch fails the query,
    unless ``order_by`` names the columns whose greatest values win, which is also the way
    for a batch with many rows of one key: they are reduced before the shuffle. The stored
    table is read once, so a chain of merges reads its first table once; closed versions go
    through the exchange with the others, each key's spread over many groups. Merge the open
    versions alone where the closed ones are kept apart, as the jobs do. ``broadcast_batch`` has
    the batch measured, and broadcast if it is small; the stored table is then not shuffled. The
    result, and what is refused, is the same either way: a key with two open versions, and an
    ``as_of`` before the version it would close. Column names beginning with ``__`` are refused.
    """
    refuse_reserved(lookup, batch)
    if order_by:
        batch = latest_per_key(batch, keys, order_by)
    small = broadcast_batch and fits_broadcast(batch)
    merge = _merge_broadcast if small else _merge_shuffled
    return merge(lookup, batch, keys, tracked, as_of)


def lookup_as_of(
    rows: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    columns: Sequence[str],
    share: float = 0.01,
) -> DataFrame:
    """``rows`` with ``columns`` of the version of their key that was open on the date ``at``: opened
    on that day or before, and not closed by then. NULL where there was none, or the key or the
    date is NULL. Names in ``columns`` must be new to ``rows``.

    Both sides meet by key and month, versions once per month they were open in, within the dates
    of ``rows``. So a key with many rows, or with many versions, is spread over its months, and
    one month of a key that still holds more than ``share`` of the rows over several tasks.
    """
    refuse_reserved(rows, history)
    day = col(at).cast("date")
    first, last = (F.lit(x).cast("date") for x in rows.agg(F.min(day), F.max(day)).first())
    month = lambda c: F.trunc(c, "month")
    until = F.least(F.coalesce(F.date_sub("updateDate", 1), last), last)
    versions = history.select(
        *[col(k) for k in keys],
        F.col("effectiveDate").alias("__from"),
        F.col("updateDate").alias("__until"),
        *[col(c) for c in columns],
        month(F.greatest("effectiveDate", first)).alias("__begin"),
        month(until).alias("__end"),
    )
    versions = versions.where("__begin <= __end").select(
        "*", F.explode(F.sequence("__begin", "__end", F.expr("interval 1 month"))).alias("__month")
    )
    open_then = (F.col("__from") <= F.col("__day")) & (
        F.col("__until").isNull() | (F.col("__day") < F.col("__until"))
    )
    found = spread_join(
        rows.withColumns({"__day": day, "__month": month(day)}),
        versions.drop("__begin", "__end"),
        [*keys, "__month"],
        "left",
        share=share,
        also=open_then,
    )
    return found.select(*[col(c) for c in [*rows.columns, *columns]])
