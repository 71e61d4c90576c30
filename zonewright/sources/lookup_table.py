"""Lookup tables on plain parquet directories.

Nothing is ever overwritten in place: a merge writes a new directory, which counts once
Spark has put ``_SUCCESS`` into it, so a job that dies half-way leaves the table as it was.
One writer at a time.

* dictionary: ``<root>/gen=<g>/add=<n>``. A merge that only inserts appends an ``add``; one
  that also changes stored rows starts a new ``gen`` with the full content.
* history: the open versions lie in a fixed number of buckets by the hash of their key. Merge
  ``n`` writes ``<root>/v=<n>/__bucket=<b>`` for the buckets it changes and no others,
  ``<root>/closed=<n>`` with the versions it closed, and last ``<root>/commit=<n>``: for each
  bucket the merge that holds it. Merge ``n`` counts once its commit is complete.

With each merge a fingerprint of its batch is stored, so that the same batch can be recognised.
``expire`` removes folders that no reader can reach any more.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.sources.size import fits_broadcast

#: Additions to a dictionary before it is gathered into one folder again.
MOST_ADDS = 64
#: Rows per bucket of a new history, and the least number of buckets. A merge rewrites whole
#: buckets, and its commit has a row for each; ``rebucket`` changes their number.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 4
_BUCKET = "__bucket"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def _numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The ``n`` of every directory ``<root>/<prefix>=<n>``, ascending."""
    fs, hadoop = _file_system(spark, root)
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    tails = [n[len(prefix) + 1 :] for n in names if n.startswith(prefix + "=")]
    return sorted(int(t) for t in tails if t.isdigit())


def _complete(spark: SparkSession, root: str, prefix: str) -> list[int]:
    return [
        n
        for n in _numbers(spark, root, prefix)
        if _exists(spark, f"{root}/{prefix}={n}/_SUCCESS")
    ]


def _generation(spark: SparkSession, root: str) -> tuple[int, list[int]] | None:
    for g in reversed(_numbers(spark, root, "gen")):
        adds = _complete(spark, f"{root}/gen={g}", "add")
        if adds:
            return g, adds
    return None


def read_dictionary(spark: SparkSession, root: str) -> DataFrame | None:
    """The dictionary at ``root``, or None if none was ever completed."""
    root = root.rstrip("/")
    found = _generation(spark, root)
    if found is None:
        return None
    g, adds = found
    return spark.read.parquet(*[f"{root}/gen={g}/add={n}" for n in adds])


def _tell_batch(spark: SparkSession, root: str, g: int, n: int, batch: str | None) -> None:
    """Store the fingerprint of a batch under the folder that will make it count."""
    if batch is not None:
        path = f"{root}/batches/gen={g}/add={n}"
        told = spark.createDataFrame([(batch,)], "batch string").coalesce(1)
        told.write.mode("overwrite").parquet(path)


def in_dictionary(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether a batch of this fingerprint has been merged into the dictionary at ``root``."""
    root = root.rstrip("/")
    found = _generation(spark, root)
    if found is None or not _exists(spark, f"{root}/batches"):
        return False
    g, adds = found
    # of the latest generation a folder may be unfinished; earlier ones have been replaced whole
    counts = (F.col("gen") < g) | ((F.col("gen") == g) & F.col("add").isin(adds))
    told = spark.read.schema("batch string, gen int, add int").parquet(f"{root}/batches")
    return not told.where(counts & (F.col("batch") == batch)).isEmpty()


def append_dictionary(
    spark: SparkSession, root: str, rows: DataFrame, batch: str | None = None
) -> str:
    """Add rows to the latest generation, in files of full size; nothing if there are none.

    Past ``MOST_ADDS`` additions the generation is written anew as one.
    """
    root = root.rstrip("/")
    found = _generation(spark, root)
    if found is None:
        raise ValueError(f"no lookup table at {root}")
    g, adds = found
    if rows.isEmpty():
        return f"{root}/gen={g}/add={adds[-1]}"
    if len(adds) >= MOST_ADDS:
        everything = read_dictionary(spark, root).unionByName(rows)
        return replace_dictionary(spark, root, everything, batch)
    _tell_batch(spark, root, g, adds[-1] + 1, batch)
    path = f"{root}/gen={g}/add={adds[-1] + 1}"
    # overwrite replaces only an unfinished attempt
    rows.hint("rebalance").write.mode("overwrite").parquet(path)
    return path


def replace_dictionary(
    spark: SparkSession, root: str, rows: DataFrame, batch: str | None = None
) -> str:
    """Write the full content as a new generation."""
    root = root.rstrip("/")
    found = _generation(spark, root)
    g = found[0] + 1 if found else 0
    _tell_batch(spark, root, g, 0, batch)
    path = f"{root}/gen={g}/add=0"
    rows.hint("rebalance").write.mode("overwrite").parquet(path)
    return path


@dataclass(frozen=True)
class History:
    """The state after merge ``number``: which merge holds each bucket that has rows."""

    number: int
    buckets: int
    holder: dict[int, int]

    def paths(self, root: str, wanted: Sequence[int] | None = None) -> list[str]:
        known = self.holder if wanted is None else [b for b in wanted if b in self.holder]
        return [f"{root}/v={self.holder[b]}/{_BUCKET}={b}" for b in sorted(known)]


def history_state(spark: SparkSession, root: str) -> History | None:
    """The state after the last complete merge: a listing, and a table of a row per bucket."""
    root = root.rstrip("/")
    for n in reversed(_numbers(spark, root, "commit")):
        if _exists(spark, f"{root}/commit={n}/_SUCCESS"):
            rows = spark.read.schema(_COMMIT).parquet(f"{root}/commit={n}").collect()
            holder = {r.bucket: r.holder for r in rows if r.bucket is not None}
            return History(n, rows[0].buckets, holder)
    return None


_COMMIT = "bucket int, holder int, buckets int, batch string"


def in_history(spark: SparkSession, root: str, state: History, batch: str) -> bool:
    """Whether a batch of this fingerprint has been merged into the history at ``root``."""
    root = root.rstrip("/")
    # a merge takes the number after the last complete one, so all up to it are complete
    paths = [f"{root}/commit={n}" for n in _numbers(spark, root, "commit") if n <= state.number]
    told = spark.read.schema(_COMMIT).parquet(*paths)
    return not told.where(F.col("batch") == batch).isEmpty()


def stored_types(spark: SparkSession, root: str, state: History | None) -> dict | None:
    """The type of each column by its name in lower case, None for a history without rows."""
    paths = state.paths(root.rstrip("/")) if state else []
    if not paths:
        return None
    return {f.name.lower(): f.dataType for f in spark.read.parquet(paths[0]).schema.fields}


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("int")


def read_current(
    spark: SparkSession, root: str, wanted: Sequence[int] | None = None
) -> DataFrame | None:
    """The open versions, of all buckets or those ``wanted``; None if there is no row there."""
    root = root.rstrip("/")
    state = history_state(spark, root)
    paths = state.paths(root, wanted) if state else []
    if not paths:
        return None
    return spark.read.parquet(*paths).withColumn("current", F.lit(True))


def read_history(spark: SparkSession, root: str) -> DataFrame | None:
    """Open and closed versions together."""
    root = root.rstrip("/")
    state = history_state(spark, root)
    current = read_current(spark, root)
    if current is None:
        return None
    numbers = [n for n in _numbers(spark, root, "closed") if n <= state.number]
    if not numbers:
        return current
    paths = [f"{root}/closed={n}" for n in numbers]
    closed = spark.read.schema(current.drop("current").schema).parquet(*paths)
    return current.unionByName(closed.withColumn("current", F.lit(False)))


def commit_changes(
    spark: SparkSession,
    root: str,
    keys: Sequence[str],
    changes: DataFrame,
    batch: str | None = None,
    buckets: int | None = None,
) -> History:
    """Apply the rows that a merge closes and opens, and return the new state.

    Only buckets with a change are read and written, in Spark's own partitioned layout; without
    a change no data is written. ``changes`` is read several times, so it should be a stored
    table. ``buckets`` counts for a new history only, and follows from its rows if not given.
    """
    root = root.rstrip("/")
    state = history_state(spark, root)
    n = state.number + 1 if state else 0
    if state:
        buckets = state.buckets
    elif buckets is None:
        buckets = max(LEAST_BUCKETS, -(-changes.count() // BUCKET_ROWS))
    numbered = changes.withColumn(_BUCKET, bucket_of(keys, buckets))
    facts = numbered.groupBy(_BUCKET).agg(F.bool_or(~F.col("current")).alias("closes")).collect()
    touched = sorted(r[_BUCKET] for r in facts)
    closed = changes.where(~F.col("current")).drop("current")
    closes = any(r.closes for r in facts)
    if touched:
        content = numbered.where("current").drop("current")
        left = read_current(spark, root, touched) if state else None
        if left is not None:
            left = left.drop("current")
            left = _without(left, closed, keys) if closes else left
            content = left.withColumn(_BUCKET, bucket_of(keys, buckets)).unionByName(content)
        _write(content.hint("rebalance", _BUCKET), f"{root}/v={n}", _BUCKET)
    _remove(spark, f"{root}/closed={n}")  # of an attempt that was not finished
    if closes:
        _write(closed.hint("rebalance"), f"{root}/closed={n}")
    holder = (state.holder if state else {}) | dict.fromkeys(touched, n)
    # a row for the fingerprint, and one for each bucket
    rows = [(None, None, buckets, batch), *[(b, h, buckets, None) for b, h in holder.items()]]
    _write(spark.createDataFrame(rows, _COMMIT).coalesce(1), f"{root}/commit={n}")
    return History(n, buckets, holder)


def _without(rows: DataFrame, closed: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [f"__key_{i}" for i in range(len(keys))]
    gone = closed.select(*[col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    same = [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    gone = F.broadcast(gone) if fits_broadcast(gone) else gone
    return rows.join(gone, reduce(and_, same), "left_anti")


def _write(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    if fs.exists(hadoop):
        fs.delete(hadoop, True)


def rebucket(spark: SparkSession, root: str, keys: Sequence[str], buckets: int) -> History | None:
    """Deal the open versions of a history to another number of buckets, as a merge of its own;
    None if there is no history."""
    root = root.rstrip("/")
    state, current = history_state(spark, root), read_current(spark, root)
    if current is None:
        return None
    n = state.number + 1
    dealt = current.drop("current").withColumn(_BUCKET, bucket_of(keys, buckets))
    _write(dealt.hint("rebalance", _BUCKET), f"{root}/v={n}", _BUCKET)
    _remove(spark, f"{root}/closed={n}")
    written = spark.read.parquet(f"{root}/v={n}").select(_BUCKET).distinct().collect()
    rows = [(None, None, buckets, None), *[(r[0], n, buckets, None) for r in written]]
    _write(spark.createDataFrame(rows, _COMMIT).coalesce(1), f"{root}/commit={n}")
    return History(n, buckets, {r[0]: n for r in written})


def expire(spark: SparkSession, root: str, before: dt.datetime) -> list[str]:
    """Remove what no reader of the latest state can reach and was last changed before a point
    in time, and return the folders removed. Reads stay as they are; a reader that opened the
    table earlier loses it, so ``before`` should lie behind the longest job.

    Of a history these are superseded buckets, with the raw values in them, of a dictionary
    earlier generations. What was written by a merge that is not finished is never removed, as
    its number is above the latest. Fingerprints of batches stay.
    """
    root = root.rstrip("/")
    state, found = history_state(spark, root), _generation(spark, root)
    old: list[str] = []
    if state:
        live = set(state.paths(root))
        for n in _numbers(spark, root, "v"):
            if n <= state.number:
                here = [f"{root}/v={n}/{_BUCKET}={b}" for b in _numbers(spark, f"{root}/v={n}", _BUCKET)]
                whole = not live.intersection(here)
                old += [f"{root}/v={n}"] if whole else [p for p in here if p not in live]
    if found:
        old += [f"{root}/gen={g}" for g in _numbers(spark, root, "gen") if g < found[0]]
    limit = before.timestamp() * 1000
    gone = [p for p in old if _changed(spark, p) < limit]
    for path in gone:
        _remove(spark, path)
    return gone


def _changed(spark: SparkSession, path: str) -> int:
    """When the newest file below ``path`` was written, in milliseconds."""
    fs, hadoop = _file_system(spark, path)
    files, newest = fs.listFiles(hadoop, True), 0
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest
