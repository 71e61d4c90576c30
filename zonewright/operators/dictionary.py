"""The lookup table kept as a dictionary: raw value -> mask, insert if absent.

Rows match on the *undelimited concatenation* of the PII values, with these effects:

* a value not seen before is inserted; stored rows are never closed;
* a key with a NULL part matches nothing, so such rows are inserted on every run;
* two different value tuples can share a key, ('ab','c') and ('a','bc'). The stored row
  then gets an ``updateDate`` and the incoming one is not inserted;
* a stored row matched by several batch rows is ambiguous and fails the query.

``scd2`` holds the other meaning, a history per business key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col, masked_name, quote, require
from zonewright.operators.heavy import spread_join
from zonewright.sources.size import fits_broadcast

# The texts stored in the status columns of a dictionary.
NO_UPDATE, CURRENT = "null", "true"

_KEY = "__key"
_HASH = "__hash"
_TOUCHED = "__touched"
_AMBIGUOUS = "several batch rows match one lookup row"


def as_date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def key_of(cols: Sequence[str]) -> Column:
    return F.concat(*[col(c).cast("string") for c in cols])


def _keyed(df: DataFrame, pii_cols: Sequence[str]) -> DataFrame:
    """With the merge key and its hash, which the joins compare first.

    Sorting by a number is cheap where sorting long text is not. And since the batch keys are
    grouped by the key alone, both sides of a join get a plain exchange, the form in which
    adaptive execution can split a value that holds much of the lookup table.
    """
    return df.withColumn(_KEY, key_of(pii_cols)).withColumn(_HASH, F.xxhash64(_KEY))


def lookup_columns(pii_cols: Sequence[str]) -> list[str]:
    return [name for c in pii_cols for name in (c, masked_name(c))]


def lookup_projection(
    df: DataFrame, pii_cols: Sequence[str], as_of: dt.date | str
) -> DataFrame:
    """``c1, masked_c1, c2, masked_c2, ..., effectiveDate``; repeated rows stay."""
    return df.select(
        *[col(c) for c in lookup_columns(pii_cols)], as_date(as_of).alias("effectiveDate")
    )


def lookup_bootstrap(batch: DataFrame) -> DataFrame:
    """The first content of a dictionary: the projection plus its two status columns.

    Both are strings, and a first-run ``updateDate`` is the text ``null``.
    """
    return batch.select("*", F.lit(NO_UPDATE).alias("updateDate"), F.lit(CURRENT).alias("current"))


def _inserted(rows: DataFrame, pii_cols: Sequence[str], as_of: dt.date | str) -> DataFrame:
    return rows.select(
        *[col(c) for c in lookup_columns(pii_cols)],
        as_date(as_of).alias("effectiveDate"),
        F.lit(None).cast("string").alias("updateDate"),
        F.lit(CURRENT).alias("current"),
    )


def lookup_first_run(
    batch: DataFrame, pii_cols: Sequence[str], as_of: dt.date | str
) -> DataFrame:
    """Bootstrap followed by an upsert of the same batch, without joining it to itself.

    Every complete key finds its own stored row, so only the keys with a NULL part are
    added again. The batch must hold each complete key once.
    """
    again = _inserted(batch.where(key_of(pii_cols).isNull()), pii_cols, as_of)
    return lookup_bootstrap(batch).unionByName(again)


def touched(
    new_masks: Sequence[Column], stored_masks: Sequence[Column], current: Column | None = None
) -> Column:
    """Whether a matched stored row gets an ``updateDate``: some mask differs.

    AND binds tighter than OR here, so ``current`` guards the first column only.
    """
    differs = [new != old for new, old in zip(new_masks, stored_masks, strict=True)]
    first = (F.col("current") if current is None else current).cast("boolean") & differs[0]
    return reduce(lambda a, b: a | b, differs[1:], first)


def upsert_parts(
    lookup: DataFrame,
    batch: DataFrame,
    pii_cols: Sequence[str],
    as_of: dt.date | str,
    broadcast_batch: bool = False,
    unique_batch: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The stored rows, with a ``__touched`` flag for a moved ``updateDate``, and the new rows.

    Batch keys are counted with a map-side partial aggregate, so a value that fills much of
    the batch shuffles as one row per task. Rows without a complete key bypass the join.
    ``broadcast_batch`` asserts that the batch keys fit an executor: the stored table is
    then never shuffled. ``unique_batch`` asserts that ``duplicate_keys`` found none in the
    batch, which saves the grouping.
    """
    masks = [masked_name(c) for c in pii_cols]
    rows = _keyed(batch, pii_cols)
    complete_rows = rows.where(F.col(_KEY).isNotNull())
    new_masks = F.struct(*[col(m) for m in masks])
    if unique_batch:
        keys = complete_rows.select(
            F.col(_KEY).alias("b_key"), F.lit(1).alias("b_rows"), new_masks.alias("b_masks")
        )
    else:
        keys = complete_rows.groupBy(F.col(_KEY).alias("b_key")).agg(
            F.count(F.lit(1)).alias("b_rows"), F.max(new_masks).alias("b_masks")
        )
    keys = keys.withColumn("b_hash", F.xxhash64("b_key"))
    small = F.broadcast(keys) if broadcast_batch else keys
    same_key = (F.col(_HASH) == F.col("b_hash")) & (F.col(_KEY) == F.col("b_key"))

    matched = F.col(_KEY).eqNullSafe(F.col("b_key"))
    marked = _keyed(lookup, pii_cols)
    # Rows without a complete key match nothing; left in a shuffled join they would all
    # meet in one task, so they go round it.
    complete = marked if broadcast_batch else marked.where(F.col(_KEY).isNotNull())
    stored = (
        complete.join(small, same_key, "left")
        # Names a column of both sides, so it is tested on matched rows only.
        .where(
            require(
                F.coalesce(~(matched & (F.col("b_rows") > 1)), F.lit(True)),
                _AMBIGUOUS,
            )
        )
        .withColumn(
            _TOUCHED,
            F.coalesce(
                touched([F.col(f"b_masks.{quote(m)}") for m in masks], [col(m) for m in masks]),
                F.lit(False),
            ),
        )
        .withColumn(
            "updateDate",
            F.when(F.col(_TOUCHED), F.lit(str(as_of))).otherwise(F.col("updateDate")),
        )
        .select(*[col(c) for c in lookup.columns], F.col(_TOUCHED))
    )
    if not broadcast_batch:
        keyless = marked.where(F.col(_KEY).isNull()).withColumn(_TOUCHED, F.lit(False))
        stored = stored.unionByName(keyless.drop(_KEY, _HASH))

    # A value with many stored rows comes as one per task; grouped by the key alone, see above.
    known = marked.where(F.col(_KEY).isNotNull()).select(_KEY).distinct()
    known = known.withColumn(_HASH, F.xxhash64(_KEY))
    if broadcast_batch:
        # At most one row per batch key is left, so this side is as small as the batch.
        known = marked.select(_HASH, _KEY).join(small, same_key, "left_semi")
        known = F.broadcast(known.distinct())
    unseen = complete_rows.join(known, [_HASH, _KEY], "left_anti")
    new = _inserted(
        unseen.unionByName(rows.where(F.col(_KEY).isNull())), pii_cols, as_of
    )
    return stored, new


def match_stored(lookup: DataFrame, batch: DataFrame, pii_cols: Sequence[str]) -> DataFrame:
    """``__hash, __key, __touched``: a row per complete key of ``batch`` that is stored. A key
    with several rows in the batch is ambiguous and fails the query.

    Both sides are reduced per key before their one exchange, the stored table to what its
    rows of a key differ in, so that a value with many rows travels as one per task.
    """
    masks = [masked_name(c) for c in pii_cols]

    def per_key(df: DataFrame, *more: str) -> DataFrame:
        facts = F.collect_set(F.struct(*[col(c) for c in (*masks, *more)])).alias("facts")
        rows = _keyed(df, pii_cols).where(F.col(_KEY).isNotNull())
        return rows.groupBy(_HASH, _KEY).agg(F.count(F.lit(1)).alias("n"), facts)

    stored = per_key(lookup, "current").select(_HASH, _KEY, F.col("facts").alias("s_facts"))
    new = per_key(batch).select(_HASH, _KEY, F.col("n").alias("b_rows"), "facts")
    said = F.col("facts")[0]  # of a key with one row; with more the match is ambiguous

    def moves(fact: Column) -> Column:
        new_masks, old_masks = [said[m] for m in masks], [fact[m] for m in masks]
        return touched(new_masks, old_masks, fact["current"])

    hit = F.coalesce(F.exists("s_facts", moves), F.lit(False))
    found = stored.join(new, [_HASH, _KEY]).select(_HASH, _KEY, "b_rows", hit.alias(_TOUCHED))
    return found.where(require(F.col("b_rows") == 1, _AMBIGUOUS)).drop("b_rows")


def unseen_rows(
    batch: DataFrame, matches: DataFrame, pii_cols: Sequence[str], as_of: dt.date | str
) -> DataFrame:
    """What an upsert inserts: rows whose key is not among ``matches``, or is not complete."""
    rows = _keyed(batch, pii_cols)
    unseen = rows.where(F.col(_KEY).isNotNull()).join(matches, [_HASH, _KEY], "left_anti")
    return _inserted(unseen.unionByName(rows.where(F.col(_KEY).isNull())), pii_cols, as_of)


def updated_rows(
    lookup: DataFrame,
    batch: DataFrame,
    matches: DataFrame,
    pii_cols: Sequence[str],
    as_of: dt.date | str,
) -> DataFrame:
    """The stored table with a new ``updateDate`` where a matched row differs from the batch.

    What the batch changes is broadcast if measured small; beyond that values with many stored
    rows are spread over several tasks.
    """
    masks = [masked_name(c) for c in pii_cols]
    moved = matches.where(F.col(_TOUCHED)).select(_HASH, _KEY)
    new = (
        _keyed(batch, pii_cols)
        .join(moved, [_HASH, _KEY], "left_semi")
        .select(_HASH, _KEY, *[col(m).alias(f"__new_{m}") for m in masks])
    )
    marked = _keyed(lookup, pii_cols)
    hit = touched([col(f"__new_{m}") for m in masks], [col(m) for m in masks], F.col("current"))
    complete = marked.where(F.col(_KEY).isNotNull())
    if fits_broadcast(new):
        complete = complete.join(F.broadcast(new), [_HASH, _KEY], "left")
    else:
        complete = spread_join(complete, new, [_HASH, _KEY], "left")
    changed = complete.withColumn(
        "updateDate",
        F.when(F.coalesce(hit, F.lit(False)), F.lit(str(as_of))).otherwise(F.col("updateDate")),
    )
    names = [col(c) for c in lookup.columns]
    return changed.select(*names).unionByName(marked.where(F.col(_KEY).isNull()).select(*names))


def lookup_upsert(
    lookup: DataFrame,
    batch: DataFrame,
    pii_cols: Sequence[str],
    as_of: dt.date | str,
    broadcast_batch: bool = False,
) -> DataFrame:
    """The whole dictionary after merging ``batch`` (a ``lookup_projection``) into it."""
    stored, new = upsert_parts(lookup, batch, pii_cols, as_of, broadcast_batch)
    return stored.drop(_TOUCHED).unionByName(new)


def merge_into_table(
    batch: DataFrame, table: str, pii_cols: Sequence[str], as_of: dt.date | str
) -> None:
    """``lookup_upsert`` as one MERGE, for a table whose catalog supports row-level changes.

    The table format then decides which files to rewrite, commits at once, and is the one to
    refuse ambiguous matches.
    """
    columns = lookup_columns(pii_cols)
    masks = [masked_name(c) for c in pii_cols]
    staged = batch.select(
        key_of(pii_cols).alias("mergeKey"), *[col(c).alias(f"new_{c}") for c in columns]
    )
    (
        staged.mergeInto(table, key_of(pii_cols) == F.col("mergeKey"))
        .whenMatched(touched([col(f"new_{m}") for m in masks], [col(m) for m in masks]))
        .update({"updateDate": F.lit(str(as_of))})
        .whenNotMatched()
        .insert(
            {quote(c): col(f"new_{c}") for c in columns}
            | {
                "effectiveDate": as_date(as_of),
                "updateDate": F.lit(None).cast("string"),
                "current": F.lit(CURRENT),
            }
        )
        .merge()
    )


def duplicate_keys(batch: DataFrame, pii_cols: Sequence[str]) -> DataFrame:
    """Complete keys that occur more than once, with their counts."""
    key = key_of(pii_cols)
    return (
        batch.where(key.isNotNull())
        .groupBy(key.alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
