"""Reconciliation of two zones and type checks, as small report DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.columns import MASK_PREFIX, col, name_folding
from zonewright.functions.fingerprint import bag_print, value_hash
from zonewright.plans.spec import CastRule, as_rules

ROWS = "*"  # report line holding the number of rows


def _report(df: DataFrame, counts: Sequence[tuple[str, Column]]) -> DataFrame:
    """One global aggregate, turned into a line per name."""
    flat = df.agg(*[c.alias(f"n{i}") for i, (_, c) in enumerate(counts)])
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("n"))
            for i, (name, _) in enumerate(counts)
        ]
    )
    return flat.select(F.inline(lines))


def _count_columns(df: DataFrame, pushed: bool) -> list[tuple[str, Column]]:
    """A count per column, after that of the rows."""
    nested = _has_nested(df)
    counts = [(ROWS, F.count(F.lit(1)))]
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # isnan(NULL) is false, so NULL needs its own test
            count = F.count(F.when(value.isNotNull() & ~F.isnan(value), 1))
        elif pushed and nested:
            # Footer null counts are kept per leaf, not per nested value: never push these.
            count = F.count(F.when(value.isNotNull(), 1))
        else:
            count = F.count(value)
        counts.append((f.name, count))
    return counts


def _has_nested(df: DataFrame) -> bool:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return any(isinstance(f.dataType, nested) for f in df.schema.fields)


def non_null_counts(df: DataFrame) -> DataFrame:
    """``column_name, n``: rows (as ``*``) and values per column, NaN counting as missing.

    One pass over the data. Where the session pushes aggregates into parquet scans, plain
    columns are counted apart from floating-point ones: their counts then come from the
    file footers, and only the floating-point columns are read.
    """
    pushed = df.sparkSession.conf.get("spark.sql.parquet.aggregatePushdown") == "true"
    counts = _count_columns(df, pushed)
    floating = (T.FloatType, T.DoubleType)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, floating)}
    if not pushed or not floats or _has_nested(df):
        return _report(df, counts)
    plain = [c for c in counts if c[0] not in floats]
    return _report(df, plain).unionByName(_report(df, [c for c in counts if c[0] in floats]))


def observe_counts(df: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df`` with its counts taken on the way, and a function giving them as a report.

    The report costs no pass of its own but is ready only after an action has run the frame
    to its end. Use it where that action has no shuffle: tasks of a stage that feeds a
    shuffle may run again after the loss of an executor, and would count twice.
    """
    observation = Observation()
    counts = _count_columns(df, pushed=False)
    observed = df.observe(observation, *[c.alias(f"n{i}") for i, (_, c) in enumerate(counts)])

    def report() -> DataFrame:
        metrics = observation.get
        rows = [(name, metrics[f"n{i}"]) for i, (name, _) in enumerate(counts)]
        return df.sparkSession.createDataFrame(rows, "column_name string, n bigint")

    return observed, report


def settle(report: DataFrame) -> DataFrame:
    """A report (one line per column) computed once, for use in several comparisons."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def mask_origins(source: DataFrame, target: DataFrame) -> dict[str, str]:
    """For columns of ``target``, the differently named one of ``source`` they come from."""
    fold = name_folding(source)
    names = {fold(c): c for c in source.columns}
    origins = {}
    for c in target.columns:
        if fold(c) in names:
            origins[c] = names[fold(c)]
        elif c.startswith(MASK_PREFIX):
            raw = c[len(MASK_PREFIX) :]
            origins[c] = names.get(fold(raw), raw)
    return {c: raw for c, raw in origins.items() if c != raw}


def reconcile(
    source: DataFrame,
    target: DataFrame,
    masked: bool = False,
    compare_rows: bool = True,
    may_differ: Sequence[str] = (),
) -> DataFrame:
    """Compare rows and non-null values per column.

    ``column_name, source_count, target_count, status`` with status ``success``, ``failed``,
    ``missing_in_source`` or ``missing_in_target``. The ``*`` line compares row counts, or
    with ``compare_rows=False`` only asks for a non-empty target. ``masked`` compares a
    ``masked_x`` column of the target with ``x`` of the source. A differing count of a column
    in ``may_differ`` has the status ``expected``: an array that is NULL becomes a text.
    """
    origins = mask_origins(source, target) if masked else {}
    return compare_counts(
        non_null_counts(source), non_null_counts(target), origins, compare_rows, may_differ
    )


def compare_counts(
    source: DataFrame,
    target: DataFrame,
    origins: Mapping[str, str] | None = None,
    compare_rows: bool = True,
    may_differ: Sequence[str] = (),
) -> DataFrame:
    """``reconcile`` on two count reports, a line per column each."""
    source_name = F.col("column_name")
    for name, raw in (origins or {}).items():
        source_name = F.when(F.col("column_name") == name, F.lit(raw)).otherwise(source_name)
    s = source.select(F.col("column_name").alias("s_name"), F.col("n").alias("source_count"))
    t = target.select(
        F.col("column_name").alias("t_name"),
        source_name.alias("t_source"),
        F.col("n").alias("target_count"),
    )
    rows_ok = (
        F.col("source_count") == F.col("target_count")
        if compare_rows
        else F.col("target_count") > 0
    )
    ok = F.when(F.col("t_name") == ROWS, rows_ok).otherwise(
        F.col("source_count") == F.col("target_count")
    )
    return s.join(t, F.col("s_name") == F.col("t_source"), "full").select(
        F.coalesce("t_name", "s_name").alias("column_name"),
        "source_count",
        "target_count",
        F.when(F.col("t_name").isNull(), "missing_in_target")
        .when(F.col("s_name").isNull(), "missing_in_source")
        .when(ok, "success")
        .when(F.lower("t_name").isin([c.lower() for c in may_differ]), "expected")
        .otherwise("failed")
        .alias("status"),
    )


def value_prints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, print``: the fingerprint of each column's values as a bag, and of whole rows
    as ``*``. One aggregate that is partial in every task; only sums are shuffled."""
    prints = [(ROWS, bag_print(value_hash(df, columns)))]
    prints += [(c, bag_print(value_hash(df, [c]))) for c in columns]
    return _report(df, prints).withColumnRenamed("n", "print")


def reconcile_values(source: DataFrame, target: DataFrame) -> DataFrame:
    """Compare the values of two tables, in whatever order their rows come.

    ``column_name, source_print, target_print, status``, a line per column and one for whole
    rows, ``*``, over the columns both have. A column fails if a value was altered, lost or
    added; if values only moved to other rows, its line succeeds and that of whole rows fails.
    A column of another type is compared in the type of the target; what cannot be cast counts
    as NULL. NULL is a value like any other, all NaN are one, and 0.0 is -0.0, but see
    ``fingerprint`` for numbers inside nested values. A column of one side only has the status
    ``missing_in_source`` or ``missing_in_target``, and its print is NULL on the other.
    """
    fold = name_folding(source)
    named = {fold(f.name): f for f in source.schema.fields}
    both = [f for f in target.schema.fields if fold(f.name) in named]

    def as_target(f: T.StructField) -> Column:
        own = named[fold(f.name)]
        value = col(own.name)
        return (value if own.dataType == f.dataType else value.try_cast(f.dataType)).alias(f.name)

    names = [f.name for f in both]
    s = value_prints(source.select(*[as_target(f) for f in both]), names)
    t = value_prints(target, names)
    lines = s.withColumnRenamed("print", "source_print").join(
        t.withColumnRenamed("print", "target_print"), "column_name"
    )
    same = F.col("source_print") == F.col("target_print")
    report = lines.withColumn("status", F.when(same, "success").otherwise("failed"))
    known = {fold(n) for n in names}
    extra = [(f.name, "missing_in_target") for f in source.schema.fields if fold(f.name) not in known]
    extra += [(f.name, "missing_in_source") for f in target.schema.fields if fold(f.name) not in known]
    if not extra:
        return report
    more = source.sparkSession.createDataFrame(extra, "column_name string, status string")
    return report.unionByName(more, allowMissingColumns=True)


def check_text_types(
    df: DataFrame, rules: Sequence[str | CastRule], null_text: str | None = None
) -> DataFrame:
    """``check_types`` for a dataset whose files hold text, as CSV does.

    ``column_name, expected_type, actual_type, n, status``: a value has the type of its rule if
    reading it and writing it again gives the same text, so the scale must be right, and so
    must signs, leading zeros and exponents. Any text is a string. ``actual_type`` is ``text``,
    or ``missing``; ``n`` counts the values of the type. NULL, or ``null_text``, is no value.
    All columns are checked in one aggregate.
    """
    fold = name_folding(df)
    by_name = {fold(f.name): f for f in df.schema.fields}
    decided = {rule.column: rule for rule in as_rules(rules)}  # the last rule on a column
    if not decided:
        raise ValueError("no cast rules to check")
    counts, facts = [], {}
    for name, rule in decided.items():
        found = by_name.get(fold(name))
        expected = f"decimal scale {rule.scale}" if rule.kind == "decimal" else "string"
        facts[name] = expected, "text" if found else "missing"
        if not found:
            counts.append((name, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("bad"))))
            continue
        value = col(found.name).cast("string")
        value = value if null_text is None else F.nullif(value, F.lit(null_text))
        ok = F.lit(True)
        if rule.kind == "decimal":
            again = value.try_cast(f"decimal({rule.precision},{rule.scale})").cast("string")
            ok = F.coalesce(again == value, F.lit(False))
        held = value.isNotNull()
        counts.append((name, F.struct(F.count_if(held & ok).alias("n"), F.count_if(held & ~ok).alias("bad"))))

    def fact(i: int) -> Column:
        pairs = [F.lit(x) for name, values in facts.items() for x in (name, values[i])]
        return F.create_map(*pairs)[F.col("column_name")]

    return _report(df, counts).select(
        "column_name",
        fact(0).alias("expected_type"),
        fact(1).alias("actual_type"),
        F.col("n.n").alias("n"),
        F.when(F.col("n.bad") == 0, "success").otherwise("failed").alias("status"),
    )


def check_types(
    df: DataFrame, rules: Sequence[str | CastRule], count_values: bool = True
) -> DataFrame:
    """Check that every cast column has its rule's type, for every value it holds.

    ``column_name, expected_type, actual_type, n, status``: the type is the column's, so one
    odd row cannot hide. ``n`` counts the non-null values that carry it; without
    ``count_values`` it is NULL and the data is not read.
    """
    fold = name_folding(df)
    by_name = {fold(f.name): f.dataType for f in df.schema.fields}
    facts: dict[str, tuple[str, str, str]] = {}
    for rule in as_rules(rules):  # the last rule on a column decides its type
        kind = by_name.get(fold(rule.column))
        if rule.kind == "decimal":
            expected = f"decimal scale {rule.scale}"
            ok = isinstance(kind, T.DecimalType) and kind.scale == rule.scale
        else:
            expected, ok = "string", isinstance(kind, T.StringType)
        actual = kind.simpleString() if kind else "missing"
        facts[rule.column] = expected, actual, "success" if ok else "failed"
    if not facts:
        raise ValueError("no cast rules to check")
    if not count_values:
        rows = [(name, e, a, None, s) for name, (e, a, s) in facts.items()]
        return df.sparkSession.createDataFrame(
            rows,
            "column_name string, expected_type string, actual_type string, n bigint, status string",
        )

    def fact(i: int) -> Column:
        pairs = [F.lit(x) for name, values in facts.items() for x in (name, values[i])]
        return F.create_map(*pairs)[F.col("column_name")]

    counts = [
        (name, F.lit(0).cast("bigint") if actual == "missing" else F.count(col(name)))
        for name, (_, actual, _) in facts.items()
    ]
    return _report(df, counts).select(
        "column_name",
        fact(0).alias("expected_type"),
        fact(1).alias("actual_type"),
        "n",
        fact(2).alias("status"),
    )


def assert_passed(report: DataFrame) -> None:
    """Raise if any line of a report failed. A report has one line per column."""
    bad = report.where(~F.col("status").isin("success", "expected")).collect()
    if bad:
        raise ValueError("data check failed: " + "; ".join(str(r.asDict()) for r in bad))
