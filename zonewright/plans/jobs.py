"""The jobs: landing -> raw, raw -> staging, and the checked chain of both."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.columns import col, name_folding
from zonewright.functions.fingerprint import table_print
from zonewright.operators.casting import cast_columns
from zonewright.operators.dictionary import (
    duplicate_keys,
    lookup_columns,
    lookup_first_run,
    lookup_projection,
    match_stored,
    unseen_rows,
    updated_rows,
)
from zonewright.operators.masking import mask_columns, pii_swap
from zonewright.operators.quality import (
    assert_passed,
    check_text_types,
    check_types,
    compare_counts,
    mask_origins,
    non_null_counts,
    observe_counts,
    reconcile,
    reconcile_values,
    settle,
)
from zonewright.operators.scd2 import latest_per_key, scd2_changes, scd2_open
from zonewright.plans.spec import JobSpec
from zonewright.sources import lookup_table
from zonewright.sources.scratch import materialized
from zonewright.sources.zones import dataset_path, qualified, read_marked, read_zone, write_zone


def ingest(
    spark: SparkSession, spec: JobSpec, data_path: str, mode: str = "errorifexists"
) -> DataFrame:
    """Copy a dataset from landing to raw, converting the format if the zones differ."""
    _refuse_overlap(spark, spec, data_path, "raw")
    landing = _read_landing(spark, spec, data_path)
    write_zone(landing, spec.raw, data_path, mode)
    return _read_raw(spark, spec, data_path, landing)


#: Files with malformed lines that are read again by name; beyond that the dataset is.
MOST_FILES = 10_000


def ingest_with_quarantine(
    spark: SparkSession,
    spec: JobSpec,
    data_path: str,
    quarantine: Zone,
    schema: T.StructType | None = None,
    mode: str = "errorifexists",
) -> tuple[DataFrame, DataFrame]:
    """``ingest`` of a CSV landing zone whose malformed lines go to ``quarantine``, as parquet of
    ``line``, ``file`` and ``reason``; returns raw and the quarantine of this dataset.

    The scan that copies the good rows names the files that hold others, and only those files are
    read again. ``ingest`` itself stays strict.
    """
    if spec.landing.fmt != "csv":
        raise ValueError("only lines of CSV can be malformed")
    _refuse_overlap(spark, spec, data_path, "raw")
    rows = read_marked(spark, spec.landing, data_path, schema)
    named = rows.schema[:-3]  # line, file and reason come last
    seen = Observation()
    # the same whether a task ran once or twice
    observed = rows.observe(seen, F.collect_set("__file").alias("files"))
    good = observed.where(F.col("__line").isNull()).select(*[col(f.name) for f in named])
    write_zone(good, spec.raw, data_path, mode)
    files = seen.get["files"]
    some = files if len(files) <= MOST_FILES else ()
    again = read_marked(spark, spec.landing, data_path, named, some)
    bad = again.where(F.col("__line").isNotNull()) if files else again.limit(0)
    aside = dataset_path(quarantine, data_path)
    bad.select(*[F.col(f"__{c}").alias(c) for c in ("line", "file", "reason")]).write.mode(mode).parquet(aside)
    return _read_raw(spark, spec, data_path, good), spark.read.parquet(aside)


def _refuse_overlap(spark: SparkSession, spec: JobSpec, data_path: str, *written: str) -> None:
    """What is written may not be what another step reads or writes: neither the same folder,
    by whatever name, nor one inside the other."""
    zones = {"landing": spec.landing, "raw": spec.raw, "staging": spec.staging}
    paths = {name: dataset_path(zone, data_path) for name, zone in zones.items()}
    if spec.staging_source not in (spec.raw, spec.landing):
        paths["mask source"] = dataset_path(spec.staging_source, data_path)
    if spec.lookup_path:
        paths["lookup"] = spec.lookup_path
    full = {name: qualified(spark, path).rstrip("/") + "/" for name, path in paths.items()}
    for a, b in combinations(full, 2):
        if not {a, b} & set(written) or {a, b} == {"raw", "mask source"}:
            continue
        if full[a].startswith(full[b]) or full[b].startswith(full[a]):
            raise ValueError(
                f"a zone cannot be written onto itself: {a} {full[a]} and {b} {full[b]}"
            )


def _read_landing(spark: SparkSession, spec: JobSpec, data_path: str) -> DataFrame:
    """All columns that any of its files has."""
    return read_zone(spark, spec.landing, data_path, merge_schema=True)


def _text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _read_raw(
    spark: SparkSession, spec: JobSpec, data_path: str, landing: DataFrame
) -> DataFrame:
    """The raw copy, with the names of landing. Parquet has the types just written; CSV is
    text, as for any reader."""
    schema = landing.schema if spec.raw.fmt == "parquet" else _text(landing.schema)
    return read_zone(spark, spec.raw, data_path, schema)


def validate_raw(spark: SparkSession, spec: JobSpec, data_path: str) -> DataFrame:
    """Report: does raw hold the rows and values of landing?"""
    landing = _read_landing(spark, spec, data_path)
    # CSV has neither names nor types: those of landing, by position.
    schema = landing.schema if spec.raw.fmt == "csv" else None
    return reconcile(landing, read_zone(spark, spec.raw, data_path, schema, merge_schema=True))


def validate_staging(
    spark: SparkSession,
    spec: JobSpec,
    data_path: str,
    drop_raw: bool = False,
    may_differ: Sequence[str] = (),
) -> DataFrame:
    """Report: does staging hold the values of raw, column by column? ``drop_raw`` as when it
    was written; ``may_differ`` as for ``reconcile``."""
    source = _read_staging_source(spark, spec, data_path)
    schema = _staged(source, spec, drop_raw).schema if spec.staging.fmt == "csv" else None
    target = read_zone(spark, spec.staging, data_path, schema)
    return reconcile(source, target, masked=True, compare_rows=False, may_differ=may_differ)


def validate_staging_types(spark: SparkSession, spec: JobSpec, data_path: str) -> DataFrame:
    """Report: do the files of staging hold values of the types the cast rules ask for? Parquet
    by the types of its columns, CSV by its text; partition values are text and not checked."""
    partitions = {c.lower() for c in spec.partition_cols}
    rules = [r for r in spec.cast_rules if r.column.lower() not in partitions]
    if spec.staging.fmt == "parquet":
        return check_types(read_zone(spark, spec.staging, data_path), rules)
    source = _read_staging_source(spark, spec, data_path)
    text = read_zone(spark, spec.staging, data_path, _text(_staged(source, spec).schema))
    return check_text_types(text, rules)


def _read_staging_source(spark: SparkSession, spec: JobSpec, data_path: str) -> DataFrame:
    """What staging is made from; a CSV raw zone has the names of landing."""
    if spec.staging_source == spec.raw and spec.raw.fmt == "csv" and spec.landing.fmt != "csv":
        return _read_raw(spark, spec, data_path, _read_landing(spark, spec, data_path))
    return read_zone(spark, spec.staging_source, data_path)


def lookup_values(
    values: DataFrame, spec: JobSpec, salt: str | None, on_cast_error: str
) -> DataFrame:
    """Masks beside the PII values, and the casts of the columns at hand, as in staging."""
    masked = mask_columns(values, spec.pii_cols, salt)
    fold = name_folding(masked)
    present = {fold(c) for c in masked.columns}
    rules = [r for r in spec.cast_rules if fold(r.column) in present]
    return cast_columns(masked, rules, on_cast_error)


def dictionary_batch(
    raw: DataFrame,
    spec: JobSpec,
    as_of: dt.date | str,
    salt: str | None = None,
    on_cast_error: str = "raise",
) -> DataFrame:
    """The dictionary rows of a raw dataset.

    With ``lookup_distinct`` repeats go before the masking, so only distinct values are
    hashed and the hashes do not travel through the shuffle. Floating-point values are the
    exception: 0.0 and -0.0 count as one value but differ as text.
    """
    values = raw.select(*[col(c) for c in spec.pii_cols])
    floats = any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in values.schema)
    if spec.lookup_distinct and not floats:
        values = values.distinct()
    masked = lookup_values(values, spec, salt, on_cast_error)
    batch = lookup_projection(masked, spec.pii_cols, as_of)
    return batch.distinct() if spec.lookup_distinct and floats else batch


def history_batch(
    raw: DataFrame, spec: JobSpec, salt: str | None = None, on_cast_error: str = "raise"
) -> DataFrame:
    """Business keys with their PII values and masks, one row per key where the spec says
    by which columns the last one is told."""
    names = list(dict.fromkeys([*spec.lookup_keys, *spec.pii_cols]))
    values = raw.select(*[col(c) for c in dict.fromkeys([*names, *spec.lookup_order_by])])
    if spec.lookup_order_by:
        values = latest_per_key(values, spec.lookup_keys, spec.lookup_order_by)
    masked = lookup_values(values.select(*[col(c) for c in names]), spec, salt, on_cast_error)
    columns = dict.fromkeys([*spec.lookup_keys, *lookup_columns(spec.pii_cols)])
    return masked.select(*[col(c) for c in columns])


def update_dictionary(
    spark: SparkSession, root: str, batch: DataFrame, pii_cols: Sequence[str], as_of: dt.date | str
) -> None:
    """Merge a ``lookup_projection`` into the dictionary at ``root``.

    A batch that has been merged already, the date of the run included, changes nothing, so a
    run can be repeated: its rows without a complete key are not inserted again.
    """
    with materialized(batch) as batch:
        told = table_print(batch)
        if lookup_table.in_dictionary(spark, root, told):
            return
        stored = lookup_table.read_dictionary(spark, root)
        if stored is None:
            repeats = _most(duplicate_keys(batch, pii_cols))
            if repeats:
                raise ValueError(f"{repeats} batch rows match one lookup row")
            first = lookup_first_run(batch, pii_cols, as_of)
            lookup_table.replace_dictionary(spark, root, first, told)
            return
        # The one pass over the stored table; what it gives has a row per batch key at most.
        with materialized(match_stored(stored, batch, pii_cols)) as matches:
            moved = matches.agg(F.bool_or("__touched")).first()[0]
            new = unseen_rows(batch, matches, pii_cols, as_of)
            if not moved:
                lookup_table.append_dictionary(spark, root, new, told)
                return
            # A stored row only changes when two tuples share a key: then all is rewritten.
            kept = updated_rows(stored, batch, matches, pii_cols, as_of)
            lookup_table.replace_dictionary(spark, root, kept.unionByName(new), told)


def update_history(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    as_of: dt.date | str,
    unique_batch: bool = False,
    buckets: int | None = None,
) -> None:
    """Merge rows of ``keys`` and ``tracked`` columns into the history at ``root``.

    Only the buckets of the batch's keys are read, and only those with a change are written. A
    batch that has been merged already, on the same date, changes nothing: a repeated run does
    not close what later ones opened. Unless the batch is known to be ``unique_batch``, repeated
    keys are looked for first, by a count that is partial in every task: the merge would refuse
    them too, but only after bringing all rows of a key together.
    """
    with materialized(batch) as batch:
        told = f"{table_print(batch)} {as_of}"
        state = lookup_table.history_state(spark, root)
        if state and lookup_table.in_history(spark, root, state, told):
            return
        if not unique_batch:
            _refuse_repeats(batch, keys)
        kinds = lookup_table.stored_types(spark, root, state)
        if kinds is None:
            opened = scd2_open(batch, as_of)
            lookup_table.commit_changes(spark, root, keys, opened, told, buckets)
            return
        # as stored, since the number of a bucket depends on the type
        batch = batch.select(*[col(c).cast(kinds[c.lower()]).alias(c) for c in batch.columns])
        number = lookup_table.bucket_of(keys, state.buckets)
        hit = [r[0] for r in batch.select(number).distinct().collect()]
        current = lookup_table.read_current(spark, root, hit)
        if current is None:
            changes = scd2_open(batch, as_of)
        else:
            changes = scd2_changes(current, batch, keys, tracked, as_of, broadcast_batch=True)
        with materialized(changes) as changes:
            lookup_table.commit_changes(spark, root, keys, changes, told)


def _keys_stay_apart(spec: JobSpec) -> bool:
    """Whether one row per raw key means one row per key: no cast may bring two together."""
    keys = {k.lower() for k in spec.lookup_keys}
    cast = any(r.column.lower() in keys for r in spec.cast_rules)
    return bool(spec.lookup_order_by) and not cast


def _refuse_repeats(batch: DataFrame, keys: Sequence[str]) -> None:
    repeats = _most(
        batch.groupBy(*[col(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    if repeats:
        raise ValueError(f"a business key occurs {repeats} times in the batch")


def _most(counts: DataFrame) -> int | None:
    """The greatest ``n``. One job over all partitions at once, where fetching a first row
    would go through an empty result in ever larger steps."""
    return counts.agg(F.max("n")).first()[0]


def read_lookup(spark: SparkSession, spec: JobSpec) -> DataFrame | None:
    """The whole lookup table of a dataset."""
    read = lookup_table.read_history if spec.lookup_keys else lookup_table.read_dictionary
    return read(spark, spec.lookup_path)


def raw_to_staging(
    spark: SparkSession,
    spec: JobSpec,
    data_path: str,
    as_of: dt.date | str,
    mode: str = "errorifexists",
    drop_raw: bool = False,
    salt: str | None = None,
    on_cast_error: str = "raise",
) -> DataFrame:
    """Mask, cast, swap PII, write staging, then bring the lookup table up to date.

    The lookup comes last, so a failed staging write leaves it as it was.
    """
    raw = _read_staging_source(spark, spec, data_path)
    return stage(raw, spec, data_path, as_of, mode, drop_raw, salt, on_cast_error)


def stage(
    raw: DataFrame,
    spec: JobSpec,
    data_path: str,
    as_of: dt.date | str,
    mode: str = "errorifexists",
    drop_raw: bool = False,
    salt: str | None = None,
    on_cast_error: str = "raise",
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """``raw_to_staging`` for a dataset that has been opened already. ``check`` sees the
    staging dataset before the lookup table is changed, and may raise."""
    spark = raw.sparkSession
    _refuse_overlap(spark, spec, data_path, "staging", "lookup")
    staged = _staged(raw, spec, drop_raw, salt, on_cast_error)
    write_zone(staged, spec.staging, data_path, mode, spec.partition_cols)
    # With the schema as written: partition values keep their type, CSV columns their names.
    written = read_zone(spark, spec.staging, data_path, staged.schema)
    if check:
        check(written)
    if spec.lookup_keys:
        batch = history_batch(raw, spec, salt, on_cast_error)
        unique = _keys_stay_apart(spec)
        update_history(
            spark, spec.lookup_path, batch, spec.lookup_keys, spec.pii_cols, as_of, unique,
            spec.lookup_buckets,
        )
    elif spec.pii_cols:
        batch = dictionary_batch(raw, spec, as_of, salt, on_cast_error)
        update_dictionary(spark, spec.lookup_path, batch, spec.pii_cols, as_of)
    return written


def _staged(
    raw: DataFrame,
    spec: JobSpec,
    drop_raw: bool = False,
    salt: str | None = None,
    on_cast_error: str = "raise",
) -> DataFrame:
    """The staging dataset of ``raw``. Masks before casts: a hash is that of the raw value."""
    masked = mask_columns(raw, spec.masking_cols, salt)
    masked = cast_columns(masked, spec.cast_rules, on_cast_error)
    return pii_swap(masked, spec.masking_cols, spec.pii_cols, drop_raw)


def run_chain(
    spark: SparkSession,
    spec: JobSpec,
    data_path: str,
    as_of: dt.date | str,
    mode: str = "errorifexists",
    drop_raw: bool = False,
    salt: str | None = None,
    on_cast_error: str = "raise",
    may_differ: Sequence[str] = (),
    compare_values: bool = False,
) -> DataFrame:
    """Ingest, reconcile, stage, reconcile and check types; raise at the first bad report, with
    the lookup table as it was.

    The values of landing are counted while they are copied and those of raw once for both
    comparisons. So landing is read once, raw three times (its counts, staging, the lookup
    batch, of which only the columns that matter) and staging once, for its counts.
    ``may_differ`` names columns whose counts may differ between raw and staging. Types are checked
    in parquet and in CSV staging. ``compare_values`` compares the values themselves too, those
    of landing with raw and those staging should hold with what it holds, for a pass over each.
    """
    _refuse_overlap(spark, spec, data_path, "raw", "staging", "lookup")
    landing, landing_counts = observe_counts(_read_landing(spark, spec, data_path))
    write_zone(landing, spec.raw, data_path, mode)
    raw = _read_raw(spark, spec, data_path, landing)
    # CSV is counted with the types of landing, so that NaN is no value on either side.
    typed = read_zone(spark, spec.raw, data_path, landing.schema)
    raw_counts = settle(non_null_counts(typed))
    assert_passed(compare_counts(landing_counts(), raw_counts))
    if compare_values:
        assert_passed(reconcile_values(_read_landing(spark, spec, data_path), raw))

    if spec.staging_source != spec.raw:
        raw = read_zone(spark, spec.staging_source, data_path)
        raw_counts = non_null_counts(raw)
    elif raw.schema != typed.schema:
        raw_counts = non_null_counts(raw)

    def check(staged: DataFrame) -> None:
        origins = mask_origins(raw, staged)
        counts = non_null_counts(staged)
        assert_passed(compare_counts(raw_counts, counts, origins, False, may_differ))
        # Files keep the types of parquet columns; partition values and CSV are text on disk.
        fold = name_folding(staged)
        partitions = {fold(c) for c in spec.partition_cols}
        on_disk = [r for r in spec.cast_rules if fold(r.column) not in partitions]
        if on_disk and spec.staging.fmt == "parquet":
            stored = read_zone(spark, spec.staging, data_path)
            assert_passed(check_types(stored, on_disk, count_values=False))
        elif on_disk:
            text = read_zone(spark, spec.staging, data_path, _text(staged.schema))
            assert_passed(check_text_types(text, on_disk))
        if compare_values:
            assert_passed(reconcile_values(_staged(raw, spec, drop_raw, salt, on_cast_error), staged))

    return stage(raw, spec, data_path, as_of, mode, drop_raw, salt, on_cast_error, check)
