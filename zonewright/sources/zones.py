"""Zone scans and sinks: parquet and CSV datasets below a root directory."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.columns import col, quote, require
from zonewright.plans.spec import Zone


def dataset_path(zone: Zone, data_path: str) -> str:
    return f"{zone.root.rstrip('/')}/{data_path.strip('/')}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system and without dots, as Spark will use it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString()


def csv_options(zone: Zone) -> dict:
    """The same for reading and writing: blanks stay, a quote is doubled, a backslash is a
    character."""
    options = {
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    if zone.multi_line:
        # The separator is named, as else it would be guessed from breaks within values.
        options |= {"multiLine": True, "lineSep": "\n"}
    if zone.null_text is not None:
        options["nullValue"] = zone.null_text
    return options


def read_zone(
    spark: SparkSession,
    zone: Zone,
    data_path: str,
    schema: T.StructType | str | None = None,
    header: bool = False,
    merge_schema: bool = False,
) -> DataFrame:
    """Scan a dataset. CSV without a schema gives string columns ``_c0 .. _cN``, as many as its
    first line has fields. A line with more or fewer fields fails the query, whichever columns
    it reads. ``merge_schema`` takes the columns of all parquet files, not of one of them.
    """
    path = dataset_path(zone, data_path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if zone.fmt == "parquet":
        return reader.option("mergeSchema", merge_schema).parquet(path)
    reader = reader.options(mode="FAILFAST", columnPruning=False, **csv_options(zone))
    return reader.csv(path, header=header)


def _writable(df: DataFrame, zone: Zone) -> DataFrame:
    """``df``; a value that could not be read back fails the query."""
    texts = [col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    bad = []
    if not zone.multi_line:
        message = "a CSV value holds a line break; use a parquet zone or multi_line"
        bad.append((message, [c.rlike("[\\r\\n]") for c in texts]))
    if zone.null_text is not None:
        bad.append(("a CSV value is the text for NULL", [c == zone.null_text for c in texts]))
    elif len(df.columns) == 1:  # a line with nothing on it would not be read again
        bad.append(("NULL in a CSV file of one column", [col(df.columns[0]).isNull()]))
    for message, found in bad:
        if found:
            df = df.where(require(~reduce(or_, [F.coalesce(x, F.lit(False)) for x in found]), message))
    return df


def write_zone(
    df: DataFrame,
    zone: Zone,
    data_path: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    header: bool = False,
    rebalance: bool = True,
) -> str:
    """Write a dataset and return its path; an existing path is an error unless ``mode`` says so.

    A partitioned write first rebalances on the partition columns, so each value lands in
    few files, while adaptive execution splits a value that holds much of the data into
    several tasks. ``rebalance=False`` saves that shuffle when the input is already laid out.
    """
    path = dataset_path(zone, data_path)
    if partition_by and rebalance:
        df = df.hint("rebalance", *[quote(c) for c in partition_by])
    if zone.fmt == "csv":
        df = _writable(df, zone)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if zone.fmt == "parquet":
        writer.parquet(path)
    else:
        writer.options(**csv_options(zone)).csv(path, header=header)
    return path


def read_marked(
    spark: SparkSession,
    zone: Zone,
    data_path: str,
    schema: T.StructType | None = None,
    files: Sequence[str] = (),
) -> DataFrame:
    """Scan a CSV dataset, or these ``files`` of it, malformed lines included: the columns of ``schema``, or text ones as
    ``read_zone``, and ``__line``, ``__file`` and ``__reason`` of a malformed line, whose other
    columns are NULL. The reason is ``fields`` for another number of them, else ``type``.
    """
    path = dataset_path(zone, data_path)
    options = csv_options(zone) | {"columnPruning": False}
    if schema is None:
        schema = spark.read.options(**options).csv(path).schema
    corrupt = T.StructField("__line", T.StringType())
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord="__line", **options)
    rows = reader.schema(T.StructType([*schema.fields, corrupt])).csv(list(files) or path)
    # Spark refuses a query that needs nothing but the malformed lines, so their test takes in the
    # other columns too: a hash is never above the greatest int.
    parsed = F.hash(*[col(f.name) for f in schema.fields]) <= F.lit(2**31 - 1)
    is_good = ~(F.col("__line").isNotNull() & parsed)
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], corrupt])
    again = F.from_csv("__line", text.toDDL(), {**options, "columnNameOfCorruptRecord": "__line"})
    wrong_fields = again.getField("__line").isNotNull()
    return rows.select(
        *[F.when(is_good, col(f.name)).alias(f.name) for f in schema.fields],
        F.when(~is_good, F.col("__line")).alias("__line"),
        F.when(~is_good, F.col("_metadata.file_path")).alias("__file"),
        F.when(~is_good & wrong_fields, "fields").when(~is_good, "type").alias("__reason"),
    )
