"""Registered queries, each with the SQL that gives the same rows.

Every query reads whole tables. Where an operator needs two states of the world (a stored
lookup table and a batch), both are derived from the dates in ``orders``.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from zonewright import (  # noqa: E402
    JobSpec,
    Zone,
    cast_columns,
    check_text_types,
    check_types,
    detect_changes,
    lookup_bootstrap,
    lookup_first_run,
    lookup_projection,
    lookup_upsert,
    mask_columns,
    pii_swap,
    read_zone,
    reconcile,
    reconcile_values,
    scd2_merge,
    scd2_open,
    stage_updates,
    write_zone,
)
from zonewright.operators.scd2 import latest_per_key, lookup_as_of  # noqa: E402
from zonewright.plans.jobs import (  # noqa: E402
    ingest,
    ingest_with_quarantine,
    raw_to_staging,
    read_lookup,
    run_chain,
    update_dictionary,
    update_history,
    validate_raw,
    validate_staging,
)
from zonewright.sources.lookup_table import expire, read_dictionary, read_history  # noqa: E402
from zonewright.sources.scratch import scratch_dir  # noqa: E402

try:
    import corpus_pipeline
    from zonewright.llm import queries as llm
except ModuleNotFoundError as missing:  # both can be left out, and so can what only they need
    name = str(missing.name)
    if name.startswith("zonewright") and not name.startswith("zonewright.llm"):
        raise
    corpus_pipeline = llm = None

AS_OF_DAYS = ("1994-03-01", "1996-08-15", "1998-02-28")
DAY_1, DAY_2, DAY_3 = "2024-01-01", "2024-02-01", "2024-03-01"

CUSTOMER_RULES = ("c_acctbal:DecimalType:DoubleType:2", "c_nationkey:StringType:IntegerType")
EVENT_RULES = ("value:DecimalType:DoubleType:1", "event_id:StringType:LongType")
PRICE_RULES = (
    "l_extendedprice:DecimalType:DoubleType:2",
    "l_quantity:DecimalType:DoubleType:0",
    "l_discount:DecimalType:DoubleType:1",
    "l_tax:DecimalType:DoubleType:4",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_zone(spark, Zone(sf_dir), f"{name}.parquet")


def customer_spec(spark: SparkSession, sf_dir: str, **changes) -> JobSpec:
    root = scratch_dir(spark)
    settings = {
        "dataset": "customer",
        "landing": Zone(sf_dir),
        "raw": Zone(f"{root}/raw"),
        "staging": Zone(f"{root}/staging"),
        "masking_cols": ("c_name", "c_mktsegment"),
        "cast_rules": CUSTOMER_RULES,
        "pii_cols": ("c_name",),
        "lookup_path": f"{root}/lookup",
    }
    return JobSpec(**(settings | changes))


def event_spec(spark: SparkSession, sf_dir: str, **changes) -> JobSpec:
    root = scratch_dir(spark)
    settings = {
        "dataset": "events",
        "landing": Zone(sf_dir),
        "raw": Zone(f"{root}/raw"),
        "staging": Zone(f"{root}/staging"),
        "masking_cols": ("user_id", "props"),
        "cast_rules": EVENT_RULES,
        "pii_cols": ("user_id",),
        "lookup_path": f"{root}/lookup",
        "lookup_distinct": True,
    }
    return JobSpec(**(settings | changes))


# -- sources and sinks -----------------------------------------------------------------


def ingest_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(spark, customer_spec(spark, sf_dir), "orders.parquet")


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    root = scratch_dir(spark)
    spec = customer_spec(
        spark, sf_dir, landing=Zone(f"{root}/landing", "csv"), raw=Zone(f"{root}/raw", "csv")
    )
    write_zone(customer, spec.landing, "customer")
    return ingest(spark, spec, "customer").toDF(*customer.columns)


def ingest_csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of text, some of them without a field, with one more, or with a key that
    is no number. Good rows and the lines that were put aside, as one table."""
    root = scratch_dir(spark)
    key = F.col("c_custkey")
    name = F.concat(F.lit('"'), "c_name", F.lit(', Inc"'))
    line = (
        F.when(key % 50 == 0, F.concat_ws(",", key, name, "c_nationkey"))
        .when(key % 50 == 1, F.concat_ws(",", key, name, "c_nationkey", "c_mktsegment", F.lit("more")))
        .when(key % 50 == 2, F.concat_ws(",", F.concat(F.lit("no"), key), name, "c_nationkey", "c_mktsegment"))
        .otherwise(F.concat_ws(",", key, name, "c_nationkey", "c_mktsegment"))
    )
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(f"{root}/landing/customer")
    spec = customer_spec(spark, sf_dir, landing=Zone(f"{root}/landing", "csv"), raw=Zone(f"{root}/raw"))
    schema = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").schema
    good, bad = ingest_with_quarantine(spark, spec, "customer", Zone(f"{root}/aside"), schema)
    return good.unionByName(bad.select("line", "reason"), allowMissingColumns=True)


def ingest_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = customer_spec(spark, sf_dir, raw=Zone(f"{scratch_dir(spark)}/raw", "csv"))
    names = table(spark, sf_dir, "part").columns
    return ingest(spark, spec, "part.parquet").toDF(*names)


def ingest_documents_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and blanks, through a CSV zone and back."""
    raw = Zone(f"{scratch_dir(spark)}/raw", "csv", multi_line=True, null_text="\\N")
    ingest(spark, customer_spec(spark, sf_dir, raw=raw), "documents.parquet")
    return read_zone(spark, raw, "documents.parquet", table(spark, sf_dir, "documents").schema)


def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = Zone(scratch_dir(spark))
    write_zone(
        table(spark, sf_dir, "lineitem"), zone, "lineitem", partition_by=["l_returnflag"]
    )
    return read_zone(spark, zone, "lineitem")


# -- projections -----------------------------------------------------------------------


def mask_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_columns(table(spark, sf_dir, "customer"), ["c_name", "c_custkey"])


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_columns(table(spark, sf_dir, "documents"), ["text", "source"]).drop("text")


def cast_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_columns(table(spark, sf_dir, "lineitem"), PRICE_RULES)


def cast_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["o_orderdate:StringType:TimestampType", "o_totalprice:StringType:DoubleType"]
    return cast_columns(table(spark, sf_dir, "orders"), rules)


def array_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("p_size") > 5, F.split("p_name", " "))
    part = table(spark, sf_dir, "part").withColumn("p_name", words)
    return cast_columns(part, ["p_name:StringType:ArrayType"])


def pii_swap_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_columns(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return pii_swap(masked, ["c_name", "c_mktsegment"], ["c_name"])


def pii_swap_drop_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask_columns(table(spark, sf_dir, "conversations"), ["text", "role"])
    return pii_swap(masked, ["text", "role"], ["text"], drop_raw=True)


# -- the dictionary --------------------------------------------------------------------

NAMES = ["c_name", "c_mktsegment"]


def _customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_projection(mask_columns(table(spark, sf_dir, "customer"), NAMES), NAMES, DAY_1)


def lookup_projection_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_lookup(spark, sf_dir)


def lookup_bootstrap_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_bootstrap(_customer_lookup(spark, sf_dir))


def lookup_first_run_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First run over values of which some are NULL: those rows come twice."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    cols = ["o_orderkey", "o_orderstatus"]
    return lookup_first_run(lookup_projection(mask_columns(orders, cols), cols, DAY_1), cols, DAY_1)


def _buyers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with an order up to 1995, and those with one after; the segment of the
    latter has a new name where they are in debt."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    in_time = F.col("o_orderdate") < "1996-01-01"
    early = customer.join(orders.where(in_time), "c_custkey", "left_semi")
    segment = F.when(F.col("c_acctbal") < 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    late = customer.join(orders.where(~in_time), "c_custkey", "left_semi").withColumn(
        "c_mktsegment", segment
    )
    return mask_columns(early, NAMES), mask_columns(late, NAMES)


def lookup_upsert_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _buyers(spark, sf_dir)
    stored = lookup_bootstrap(lookup_projection(early, NAMES, DAY_1))
    return lookup_upsert(stored, lookup_projection(late, NAMES, DAY_2), NAMES, DAY_2)


def lookup_upsert_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names stored in two parts. In the batch a third of them are cut elsewhere, which gives
    the same key, a third are new, and some have no second part on either side."""
    kind, parts = F.col("c_custkey") % 3, ["head", "tail"]

    def lookup(cut, name, day: str) -> DataFrame:
        tail = F.substr(name, cut + 1, F.lit(99))
        rows = table(spark, sf_dir, "customer").select(
            F.substr(name, F.lit(1), cut).alias("head"),
            F.when(F.col("c_custkey") % 7 != 0, tail).alias("tail"),
        )
        return lookup_projection(mask_columns(rows, parts), parts, day)

    stored = lookup_bootstrap(lookup(F.lit(12), F.col("c_name"), DAY_1))
    cut = F.when(kind == 1, 10).otherwise(12)
    name = F.when(kind == 2, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    return lookup_upsert(stored, lookup(cut, name, DAY_2), parts, DAY_2)


def lookup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary whose first batch, with keys that are not complete, is merged three times on
    one day, in another order of rows each time."""
    cols = ["o_orderkey", "o_orderstatus"]
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
    )
    batch = lookup_projection(mask_columns(orders, cols), cols, DAY_1)
    root = f"{scratch_dir(spark)}/lookup"
    for order in (cols, cols[::-1], cols):
        update_dictionary(spark, root, batch.repartition(4, *order), cols, DAY_1)
    return read_dictionary(spark, root)


# -- the type-2 history ----------------------------------------------------------------

KEYS = ["o_custkey"]
TRACKED = ["o_orderstatus", "o_orderpriority"]


def _order_states(spark: SparkSession, sf_dir: str, spans: list | None = None) -> list[DataFrame]:
    """Per customer, status and priority of the last order, in each of three spans of days."""
    orders = table(spark, sf_dir, "orders").select(*KEYS, "o_orderdate", "o_orderkey", *TRACKED)
    date = F.col("o_orderdate")
    spans = spans or [
        date < "1996-01-01",
        (date >= "1996-01-01") & (date < "1999-01-01"),
        date >= "1999-01-01",
    ]
    order_by = ["o_orderdate", "o_orderkey"]
    last = [latest_per_key(orders.where(span), KEYS, order_by) for span in spans]
    return [mask_columns(df.select(*KEYS, *TRACKED), ["o_orderstatus"]) for df in last]


def _order_halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The same before and after one day."""
    date = F.col("o_orderdate")
    return _order_states(spark, sf_dir, [date < "1996-01-01", date >= "1996-01-01"])


def detect_changes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _order_halves(spark, sf_dir)
    return detect_changes(scd2_open(first, DAY_1), second, KEYS, TRACKED)


def stage_updates_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _order_halves(spark, sf_dir)
    changed = detect_changes(scd2_open(first, DAY_1), second, KEYS, TRACKED)
    return stage_updates(changed, second, KEYS)


def scd2_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second, third = _order_states(spark, sf_dir)
    history = scd2_merge(scd2_open(first, DAY_1), second, KEYS, TRACKED, DAY_2)
    return scd2_merge(history, third, KEYS, TRACKED, DAY_3)


def scd2_merge_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merges, by the way taken for small batches."""
    first, second, third = _order_states(spark, sf_dir)
    history = scd2_open(first, DAY_1)
    for batch, day in ((second, DAY_2), (third, DAY_3)):
        history = scd2_merge(history, batch, KEYS, TRACKED, day, broadcast_batch=True)
    return history


def lookup_history_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merges on a stored history, with replays of two batches and expiry between."""
    first, second, third = _order_states(spark, sf_dir)
    root = f"{scratch_dir(spark)}/lookup"
    for batch, day in ((first, DAY_1), (second, DAY_2), (first, DAY_1), (third, DAY_3), (second, DAY_2)):
        update_history(spark, root, batch, KEYS, TRACKED, day)
    expire(spark, root, dt.datetime.now())
    return read_history(spark, root)


def lookup_as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the state its customer had on that day, from three merges."""
    history = None
    for batch, day in zip(_order_states(spark, sf_dir), AS_OF_DAYS, strict=True):
        opened = scd2_open(batch, day)
        history = opened if history is None else scd2_merge(history, batch, KEYS, TRACKED, day)
    named = {c: f"then_{c}" for c in TRACKED}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lookup_as_of(orders, history.withColumnsRenamed(named), KEYS, "o_orderdate", list(named.values()))


def scd2_merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch holds every event of a user; the last one counts."""
    events = table(spark, sf_dir, "events")
    stored = latest_per_key(
        events.where("ts < '2024-01-03'").select("user_id", "ts", "event_id", "event_type"),
        ["user_id"],
        ["ts", "event_id"],
    )
    batch = events.where("ts >= '2024-01-03'").select("user_id", "ts", "event_id", "event_type")
    return scd2_merge(
        scd2_open(stored, DAY_1),
        batch,
        ["user_id"],
        ["event_type"],
        DAY_2,
        order_by=["ts", "event_id"],
    )


# -- checks ----------------------------------------------------------------------------


def reconcile_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing zone with NULL and NaN, which count as no values."""
    landing = Zone(f"{scratch_dir(spark)}/landing")
    price = F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice"))
    priority = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders")
    write_zone(
        orders.withColumns({"o_totalprice": price, "o_orderpriority": priority}), landing, "orders"
    )
    spec = customer_spec(spark, sf_dir, landing=landing)
    ingest(spark, spec, "orders")
    return validate_raw(spark, spec, "orders")


def reconcile_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target with lost values, a lost column and a column of its own."""
    lineitem = table(spark, sf_dir, "lineitem")
    target = lineitem.withColumns(
        {
            "l_discount": F.when(F.col("l_discount") > 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(F.lit(float("nan"))),
            "l_extra": F.lit("x"),
        }
    ).drop("l_quantity")
    report = reconcile(lineitem, target)
    return report.fillna(0, ["source_count", "target_count"])


def reconcile_values_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with all that counts cannot see: altered values, values moved between rows, and
    another sign of zero, which is none."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_zero", F.when(F.col("o_orderkey") % 3 == 0, float("nan")).otherwise(0.0)
    )
    # neighbours in the order of keys, told by numbers that each side has once
    pairs = orders.select(
        (F.col("o_orderkey").bitwiseXOR(F.lit(1))).alias("o_orderkey"), F.col("o_orderpriority").alias("moved")
    )
    shifted = F.when(F.col("o_orderkey") % 1000 == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    target = orders.join(pairs, "o_orderkey", "left").select(
        "o_orderkey",
        shifted.alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.coalesce("moved", "o_orderpriority").alias("o_orderpriority"),
        (-F.col("o_zero")).alias("o_zero"),
        F.lit(1).alias("o_extra"),
    )
    return reconcile_values(orders, target).select("column_name", "status")


def check_text_types_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as CSV holds them: one with its scale, one without its trailing zeros, one with a
    scale that its rule does not have."""
    lineitem = table(spark, sf_dir, "lineitem")
    text = lineitem.select(
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("l_extendedprice"),
        F.regexp_replace(F.col("l_discount").cast("decimal(5,2)").cast("string"), "0+$", "").alias("l_discount"),
        F.col("l_tax").cast("decimal(5,2)").cast("string").alias("l_tax"),
        "l_returnflag",
    )
    rules = ("l_extendedprice:DecimalType:DoubleType:2", "l_discount:DecimalType:DoubleType:2",
             "l_tax:DecimalType:DoubleType:4", "l_returnflag:StringType:StringType", "l_lost:StringType:StringType")
    return check_text_types(text, rules)


def reconcile_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = customer_spec(spark, sf_dir, raw=Zone(sf_dir))
    raw_to_staging(spark, spec, "customer.parquet", DAY_1)
    return validate_staging(spark, spec, "customer.parquet")


def _csv_zones(spark: SparkSession, sf_dir: str) -> JobSpec:
    root = scratch_dir(spark)
    return customer_spec(
        spark, sf_dir, raw=Zone(f"{root}/raw", "csv"), staging=Zone(f"{root}/staging", "csv")
    )


def reconcile_staging_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _csv_zones(spark, sf_dir)
    run_chain(spark, spec, "customer.parquet", DAY_1)
    return validate_staging(spark, spec, "customer.parquet")


def check_types_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = cast_columns(table(spark, sf_dir, "lineitem"), PRICE_RULES)
    return check_types(staged, [*PRICE_RULES, "l_shipdate:StringType:TimestampType"])


# -- jobs ------------------------------------------------------------------------------


def raw_to_staging_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = customer_spec(spark, sf_dir, raw=Zone(sf_dir))
    return raw_to_staging(spark, spec, "customer.parquet", DAY_1)


def staging_lookup_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary after two runs: the second finds every user known."""
    spec = event_spec(spark, sf_dir, raw=Zone(sf_dir))
    raw_to_staging(spark, spec, "events.parquet", DAY_1)
    raw_to_staging(spark, spec, "events.parquet", DAY_2, mode="overwrite")
    return read_lookup(spark, spec)


def staging_lookup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after two runs, of which the second changes the masked segment."""
    first = customer_spec(
        spark,
        sf_dir,
        raw=Zone(sf_dir),
        pii_cols=("c_mktsegment",),
        masking_cols=("c_mktsegment",),
        lookup_keys=("c_custkey",),
    )
    raw_to_staging(spark, first, "customer.parquet", DAY_1)
    later = Zone(f"{scratch_dir(spark)}/raw")
    segment = F.when(F.col("c_acctbal") < 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    write_zone(
        table(spark, sf_dir, "customer").withColumn("c_mktsegment", segment),
        later,
        "customer.parquet",
    )
    second = customer_spec(
        spark,
        sf_dir,
        raw=later,
        pii_cols=first.pii_cols,
        masking_cols=first.masking_cols,
        lookup_keys=first.lookup_keys,
        lookup_path=first.lookup_path,
    )
    raw_to_staging(spark, second, "customer.parquet", DAY_2)
    return read_lookup(spark, second)


def zone_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_chain(spark, customer_spec(spark, sf_dir), "customer.parquet", DAY_1)


def zone_chain_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and staging as CSV, so every raw value is text."""
    return run_chain(spark, _csv_zones(spark, sf_dir), "customer.parquet", DAY_1)


def zone_chain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup table that the chain leaves."""
    spec = customer_spec(spark, sf_dir)
    run_chain(spark, spec, "customer.parquet", DAY_1)
    return read_lookup(spark, spec)


def zone_chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = event_spec(spark, sf_dir, partition_cols=("event_type",))
    return run_chain(spark, spec, "events.parquet", DAY_1)


# -- contract --------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Landing to staging with all checks, on the smallest tables."""
    return zone_chain(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries; those of the subpackage ``llm`` and its pipeline only where they are there."""
    found = zone_queries()
    if llm:
        more = llm.queries() | {"pipeline": corpus_pipeline.run}
        found |= {name: with_package(query) for name, query in more.items()}
    return found


def with_package(query: Callable[[SparkSession, str], DataFrame]):
    """``query``, with Python workers that find this package; a cluster installs it on them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    found = zone_sql()
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def zone_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ingest_parquet": ingest_parquet,
        "ingest_csv": ingest_csv,
        "ingest_csv_quarantine": ingest_csv_quarantine,
        "ingest_convert": ingest_convert,
        "ingest_documents_csv": ingest_documents_csv,
        "write_partitioned": write_partitioned,
        "mask_sha256": mask_sha256,
        "mask_documents": mask_documents,
        "cast_decimal": cast_decimal,
        "cast_string": cast_string,
        "array_to_string": array_to_string,
        "pii_swap": pii_swap_customer,
        "pii_swap_drop_raw": pii_swap_drop_raw,
        "lookup_projection": lookup_projection_customer,
        "lookup_bootstrap": lookup_bootstrap_customer,
        "lookup_first_run": lookup_first_run_orders,
        "lookup_replay": lookup_replay,
        "lookup_upsert": lookup_upsert_buyers,
        "lookup_upsert_collisions": lookup_upsert_collisions,
        "detect_changes": detect_changes_orders,
        "stage_updates": stage_updates_orders,
        "scd2_merge": scd2_merge_orders,
        "scd2_merge_broadcast": scd2_merge_broadcast,
        "lookup_history_merges": lookup_history_merges,
        "lookup_as_of": lookup_as_of_orders,
        "scd2_merge_ordered": scd2_merge_ordered,
        "reconcile_zones": reconcile_zones,
        "reconcile_failures": reconcile_failures,
        "reconcile_staging": reconcile_staging,
        "reconcile_staging_csv": reconcile_staging_csv,
        "reconcile_values": reconcile_values_orders,
        "check_types": check_types_lineitem,
        "check_text_types": check_text_types_lineitem,
        "raw_to_staging": raw_to_staging_customer,
        "staging_lookup_dictionary": staging_lookup_dictionary,
        "staging_lookup_history": staging_lookup_history,
        "zone_chain": zone_chain,
        "zone_chain_csv": zone_chain_csv,
        "zone_chain_lookup": zone_chain_lookup,
        "zone_chain_events": zone_chain_events,
    }


def _counts(name: str, columns: list[str]) -> str:
    """SQL for the report on an exact copy of a table: a line per column."""
    lines = [("*", "count(*)"), *[(c, f"count({c})") for c in columns]]
    return " UNION ALL ".join(
        f"SELECT '{label}' AS column_name, {n} AS source_count, {n} AS target_count, "
        f"'success' AS status FROM {name}"
        for label, n in lines
    )


def _order_state_sql(condition: str) -> str:
    return f"""
        SELECT o_custkey, o_orderstatus, o_orderpriority,
               sha256(o_orderstatus) AS masked_o_orderstatus
        FROM orders WHERE {condition}
        QUALIFY row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


_STATES = f"""
    s1 AS ({_order_state_sql("o_orderdate < '1996-01-01'")}),
    s2 AS ({_order_state_sql("o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01'")}),
    s3 AS ({_order_state_sql("o_orderdate >= '1999-01-01'")})"""

_HALVES = f"""
    s1 AS ({_order_state_sql("o_orderdate < '1996-01-01'")}),
    s2 AS ({_order_state_sql("o_orderdate >= '1996-01-01'")})"""

_CHANGED = """
    SELECT s2.* FROM s2 JOIN s1 ON s1.o_custkey IS NOT DISTINCT FROM s2.o_custkey
    WHERE s1.o_orderstatus IS DISTINCT FROM s2.o_orderstatus
       OR s1.o_orderpriority IS DISTINCT FROM s2.o_orderpriority"""

_CUSTOMER_STAGED = """
    SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
           CAST(c_acctbal AS DECIMAL(10,2)) AS c_acctbal, c_mktsegment,
           sha256(c_name) AS c_name, sha256(c_mktsegment) AS masked_c_mktsegment
    FROM customer"""

_CUSTOMER_LOOKUP = f"""
    SELECT c_name, sha256(c_name) AS masked_c_name, c_mktsegment,
           sha256(c_mktsegment) AS masked_c_mktsegment, DATE '{DAY_1}' AS "effectiveDate" """


def _scd2_sql(stored: str, batch: str, day: str) -> str:
    """SQL for one type-2 merge of the order states."""
    columns = "o_custkey, o_orderstatus, o_orderpriority, masked_o_orderstatus"
    s_columns = ", ".join(f"s.{c}" for c in columns.split(", "))
    b_columns = ", ".join(f"b.{c}" for c in columns.split(", "))
    differs = """(s.o_orderstatus IS DISTINCT FROM b.o_orderstatus
                  OR s.o_orderpriority IS DISTINCT FROM b.o_orderpriority)"""
    return f"""
        SELECT {s_columns}, s."effectiveDate",
               CASE WHEN s."current" AND b.o_custkey IS NOT NULL AND {differs}
                    THEN DATE '{day}' ELSE s."updateDate" END AS "updateDate",
               s."current" AND NOT (b.o_custkey IS NOT NULL AND {differs}) AS "current"
        FROM {stored} s LEFT JOIN {batch} b ON b.o_custkey = s.o_custkey
        UNION ALL
        SELECT {b_columns}, DATE '{day}', CAST(NULL AS DATE), true
        FROM {batch} b LEFT JOIN (SELECT * FROM {stored} WHERE "current") s
             ON b.o_custkey = s.o_custkey
        WHERE s.o_custkey IS NULL OR {differs}"""


def zone_sql() -> dict[str, str]:
    customer = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    orders = [
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    ]
    part = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    untouched = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    untouched += ["l_returnflag", "l_linestatus", "l_shipdate"]
    staging_counts = f"""
        {_counts("customer", customer)}
        UNION ALL
        SELECT 'masked_c_mktsegment', count(c_mktsegment), count(c_mktsegment), 'success'
        FROM customer"""
    def merges(first: str, second: str, third: str) -> str:
        return f"""
            WITH {_STATES},
            t1 AS (
                SELECT *, DATE '{first}' AS "effectiveDate",
                       CAST(NULL AS DATE) AS "updateDate", true AS "current"
                FROM s1),
            t2 AS ({_scd2_sql("t1", "s2", second)})
            {_scd2_sql("t2", "s3", third)}"""

    merged = merges(DAY_1, DAY_2, DAY_3)
    first_run = f"""
        WITH b AS (
            SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
                   nullif(o_orderstatus, 'P') AS o_orderstatus
            FROM orders)
        SELECT o_orderkey, sha256(o_orderkey) AS masked_o_orderkey, o_orderstatus,
               sha256(o_orderstatus) AS masked_o_orderstatus,
               DATE '{DAY_1}' AS "effectiveDate", 'null' AS "updateDate",
               'true' AS "current"
        FROM b
        UNION ALL
        SELECT o_orderkey, sha256(o_orderkey), o_orderstatus, sha256(o_orderstatus),
               DATE '{DAY_1}', NULL, 'true'
        FROM b WHERE o_orderkey || o_orderstatus IS NULL"""
    bought = "SELECT o_custkey FROM orders WHERE o_orderdate"
    events_staged = """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts, event_type,
               CAST(value AS DECIMAL(10,1)) AS value, props,
               sha256(CAST(user_id AS VARCHAR)) AS user_id, sha256(props) AS masked_props
        FROM events"""
    return {
        "ingest_parquet": "SELECT * FROM orders",
        "ingest_csv": "SELECT "
        + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in customer)
        + " FROM customer",
        "ingest_csv_quarantine": """
            SELECT c_custkey, c_name || ', Inc' AS c_name, c_nationkey, c_mktsegment,
                   CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS reason
            FROM customer WHERE c_custkey % 50 > 2
            UNION ALL
            SELECT NULL, NULL, NULL, NULL,
                   CASE c_custkey % 50
                       WHEN 0 THEN concat_ws(',', c_custkey, '"' || c_name || ', Inc"', c_nationkey)
                       WHEN 1 THEN concat_ws(',', c_custkey, '"' || c_name || ', Inc"', c_nationkey,
                                             c_mktsegment, 'more')
                       ELSE concat_ws(',', 'no' || c_custkey, '"' || c_name || ', Inc"', c_nationkey,
                                      c_mktsegment) END,
                   CASE WHEN c_custkey % 50 = 2 THEN 'type' ELSE 'fields' END
            FROM customer WHERE c_custkey % 50 <= 2""",
        "ingest_convert": "SELECT "
        + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in part)
        + " FROM part",
        "ingest_documents_csv": "SELECT * FROM documents",
        "write_partitioned": "SELECT * FROM lineitem",
        "mask_sha256": """
            SELECT *, sha256(c_name) AS masked_c_name,
                   sha256(CAST(c_custkey AS VARCHAR)) AS masked_c_custkey
            FROM customer""",
        "mask_documents": """
            SELECT * EXCLUDE (text), sha256(text) AS masked_text, sha256(source) AS masked_source
            FROM documents""",
        "cast_decimal": """
            SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(l_quantity AS DECIMAL(10,0)) AS l_quantity,
                   CAST(l_extendedprice AS DECIMAL(10,2)) AS l_extendedprice,
                   CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(10,1)) AS l_discount,
                   CAST(l_tax AS DECIMAL(10,4)) AS l_tax,
                   l_returnflag, l_linestatus, l_shipdate
            FROM lineitem""",
        "cast_string": """
            SELECT o_orderkey, o_custkey, o_orderstatus,
                   CAST(o_totalprice AS VARCHAR) AS o_totalprice,
                   CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
            FROM orders""",
        "array_to_string": """
            SELECT p_partkey,
                   CASE WHEN p_size > 5 THEN array_to_string(string_split(p_name, ' '), ',')
                        ELSE '' END AS p_name,
                   p_brand, p_type, p_size, p_retailprice
            FROM part""",
        "pii_swap": """
            SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
                   sha256(c_name) AS c_name, sha256(c_mktsegment) AS masked_c_mktsegment
            FROM customer""",
        "pii_swap_drop_raw": """
            SELECT conv_id, turn, sha256(text) AS text, sha256(role) AS masked_role
            FROM conversations""",
        "lookup_projection": f"{_CUSTOMER_LOOKUP} FROM customer",
        "lookup_bootstrap": f"""
            {_CUSTOMER_LOOKUP}, 'null' AS "updateDate", 'true' AS "current" FROM customer""",
        "lookup_first_run": first_run,
        "lookup_replay": first_run,
        "lookup_upsert": f"""
            WITH stored AS (
                SELECT * FROM customer WHERE c_custkey IN ({bought} < '1996-01-01')),
            batch AS (
                SELECT c_name,
                       CASE WHEN c_acctbal < 0 THEN 'CHANGED' ELSE c_mktsegment END
                           AS c_mktsegment
                FROM customer WHERE c_custkey IN ({bought} >= '1996-01-01'))
            {_CUSTOMER_LOOKUP}, 'null' AS "updateDate", 'true' AS "current" FROM stored
            UNION ALL
            SELECT c_name, sha256(c_name), c_mktsegment, sha256(c_mktsegment),
                   DATE '{DAY_2}', NULL, 'true'
            FROM batch
            WHERE NOT EXISTS (
                SELECT 1 FROM stored
                WHERE stored.c_name || stored.c_mktsegment = batch.c_name || batch.c_mktsegment)
            """,
        "lookup_upsert_collisions": f"""
            WITH parts AS (
                SELECT c_custkey, c_custkey % 7 = 0 AS short, c_name,
                       CASE WHEN c_custkey % 3 = 1 THEN 10 ELSE 12 END AS cut,
                       CASE WHEN c_custkey % 3 = 2 THEN c_name || 'x' ELSE c_name END AS name
                FROM customer),
            both_sides AS (
                SELECT substr(c_name, 1, 12) AS head,
                       CASE WHEN NOT short THEN substr(c_name, 13) END AS tail,
                       DATE '{DAY_1}' AS "effectiveDate",
                       CASE WHEN c_custkey % 3 = 1 AND NOT short THEN '{DAY_2}' ELSE 'null' END
                           AS "updateDate"
                FROM parts
                UNION ALL
                SELECT substr(name, 1, cut), CASE WHEN NOT short THEN substr(name, cut + 1) END,
                       DATE '{DAY_2}', NULL
                FROM parts WHERE short OR c_custkey % 3 = 2)
            SELECT head, sha256(head) AS masked_head, tail, sha256(tail) AS masked_tail,
                   "effectiveDate", "updateDate", 'true' AS "current"
            FROM both_sides""",
        "detect_changes": f"WITH {_HALVES} {_CHANGED}",
        "stage_updates": f"""
            WITH {_HALVES}
            SELECT CAST(NULL AS VARCHAR) AS "mergeKey", c.* FROM ({_CHANGED}) c
            UNION ALL
            SELECT CAST(o_custkey AS VARCHAR), s2.* FROM s2""",
        "scd2_merge": merged,
        "scd2_merge_broadcast": merged,
        "lookup_history_merges": merged,
        "lookup_as_of": f"""
            SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, h.o_orderstatus AS then_o_orderstatus,
                   h.o_orderpriority AS then_o_orderpriority
            FROM orders o LEFT JOIN ({merges(*AS_OF_DAYS)}) h
            ON h.o_custkey = o.o_custkey AND h."effectiveDate" <= o.o_orderdate::DATE
               AND (h."updateDate" IS NULL OR o.o_orderdate::DATE < h."updateDate")""",
        "scd2_merge_ordered": f"""
            WITH last AS (
                SELECT user_id, ts, event_id, event_type, ts >= '2024-01-03' AS late
                FROM events
                QUALIFY row_number() OVER (
                    PARTITION BY user_id, late ORDER BY ts DESC, event_id DESC) = 1),
            s AS (SELECT * FROM last WHERE NOT late),
            b AS (SELECT * FROM last WHERE late)
            SELECT s.user_id, s.ts, s.event_id, s.event_type, DATE '{DAY_1}' AS "effectiveDate",
                   CASE WHEN b.event_type <> s.event_type THEN DATE '{DAY_2}' END
                       AS "updateDate",
                   coalesce(b.event_type = s.event_type, true) AS "current"
            FROM s LEFT JOIN b ON s.user_id = b.user_id
            UNION ALL
            SELECT b.user_id, b.ts, b.event_id, b.event_type, DATE '{DAY_2}', NULL, true
            FROM b LEFT JOIN s ON s.user_id = b.user_id
            WHERE s.user_id IS NULL OR b.event_type <> s.event_type""",
        "reconcile_zones": _counts(
            """(SELECT * REPLACE (CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END
                                      AS o_totalprice,
                                  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END
                                      AS o_orderpriority) FROM orders)""",
            orders,
        ),
        "reconcile_failures": _counts("lineitem", untouched)
        + """
            UNION ALL
            SELECT 'l_discount', count(*), count(*) FILTER (l_discount > 0), 'failed'
            FROM lineitem
            UNION ALL
            SELECT 'l_tax', count(*), count(*) FILTER (l_tax > 0), 'failed' FROM lineitem
            UNION ALL
            SELECT 'l_quantity', count(*), 0, 'missing_in_target' FROM lineitem
            UNION ALL
            SELECT 'l_extra', 0, count(*), 'missing_in_source' FROM lineitem""",
        "reconcile_staging": staging_counts,
        "reconcile_staging_csv": staging_counts,
        "check_types": """
            SELECT 'l_extendedprice' AS column_name, 'decimal scale 2' AS expected_type,
                   'decimal(10,2)' AS actual_type, count(l_extendedprice) AS n,
                   'success' AS status
            FROM lineitem
            UNION ALL
            SELECT 'l_quantity', 'decimal scale 0', 'decimal(10,0)', count(l_quantity), 'success'
            FROM lineitem
            UNION ALL
            SELECT 'l_discount', 'decimal scale 1', 'decimal(10,1)', count(l_discount), 'success'
            FROM lineitem
            UNION ALL
            SELECT 'l_tax', 'decimal scale 4', 'decimal(10,4)', count(l_tax), 'success'
            FROM lineitem
            UNION ALL
            SELECT 'l_shipdate', 'string', 'timestamp_ntz', count(l_shipdate), 'failed'
            FROM lineitem""",
        "reconcile_values": """
            WITH s AS (
                SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'NaN'::DOUBLE ELSE 0 END AS o_zero FROM orders),
            t AS (
                SELECT s.o_orderkey,
                       CASE WHEN s.o_orderkey % 1000 = 1 THEN s.o_custkey + 1 ELSE s.o_custkey END AS o_custkey,
                       s.o_orderstatus, s.o_totalprice,
                       coalesce(p.o_orderpriority, s.o_orderpriority) AS o_orderpriority, s.o_zero
                FROM s LEFT JOIN s p ON p.o_orderkey = xor(s.o_orderkey, 1)),
            differ(column_name, n) AS (
                SELECT '*', (SELECT count(*) FROM (
                    (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_zero FROM s)
                    EXCEPT ALL SELECT * FROM t))
                UNION ALL SELECT 'o_orderkey', (SELECT count(*) FROM (
                    SELECT o_orderkey FROM s EXCEPT ALL SELECT o_orderkey FROM t))
                UNION ALL SELECT 'o_custkey', (SELECT count(*) FROM (
                    SELECT o_custkey FROM s EXCEPT ALL SELECT o_custkey FROM t))
                UNION ALL SELECT 'o_orderstatus', (SELECT count(*) FROM (
                    SELECT o_orderstatus FROM s EXCEPT ALL SELECT o_orderstatus FROM t))
                UNION ALL SELECT 'o_totalprice', (SELECT count(*) FROM (
                    SELECT o_totalprice FROM s EXCEPT ALL SELECT o_totalprice FROM t))
                UNION ALL SELECT 'o_orderpriority', (SELECT count(*) FROM (
                    SELECT o_orderpriority FROM s EXCEPT ALL SELECT o_orderpriority FROM t))
                UNION ALL SELECT 'o_zero', (SELECT count(*) FROM (
                    SELECT o_zero FROM s EXCEPT ALL SELECT o_zero FROM t)))
            SELECT column_name, CASE WHEN n = 0 THEN 'success' ELSE 'failed' END AS status FROM differ
            UNION ALL SELECT 'o_orderdate', 'missing_in_target'
            UNION ALL SELECT 'o_extra', 'missing_in_source'""",
        "check_text_types": """
            SELECT 'l_extendedprice' AS column_name, 'decimal scale 2' AS expected_type,
                   'text' AS actual_type, count(*) AS n, 'success' AS status FROM lineitem
            UNION ALL
            SELECT 'l_discount', 'decimal scale 2', 'text',
                   count(*) FILTER (CAST(l_discount AS DECIMAL(5,2)) * 100 % 10 <> 0),
                   CASE WHEN count(*) FILTER (CAST(l_discount AS DECIMAL(5,2)) * 100 % 10 = 0) = 0
                        THEN 'success' ELSE 'failed' END
            FROM lineitem
            UNION ALL
            SELECT 'l_tax', 'decimal scale 4', 'text', 0,
                   CASE WHEN count(*) = 0 THEN 'success' ELSE 'failed' END FROM lineitem
            UNION ALL
            SELECT 'l_returnflag', 'string', 'text', count(l_returnflag), 'success' FROM lineitem
            UNION ALL
            SELECT 'l_lost', 'string', 'missing', 0, 'failed'""",
        "raw_to_staging": _CUSTOMER_STAGED,
        "staging_lookup_dictionary": f"""
            SELECT DISTINCT user_id, sha256(CAST(user_id AS VARCHAR)) AS masked_user_id,
                   DATE '{DAY_1}' AS "effectiveDate", 'null' AS "updateDate",
                   'true' AS "current"
            FROM events""",
        "staging_lookup_history": f"""
            SELECT c_custkey, c_mktsegment, sha256(c_mktsegment) AS masked_c_mktsegment,
                   DATE '{DAY_1}' AS "effectiveDate",
                   CASE WHEN c_acctbal < 0 THEN DATE '{DAY_2}' END AS "updateDate",
                   c_acctbal >= 0 AS "current"
            FROM customer
            UNION ALL
            SELECT c_custkey, 'CHANGED', sha256('CHANGED'), DATE '{DAY_2}', NULL, true
            FROM customer WHERE c_acctbal < 0""",
        "zone_chain": _CUSTOMER_STAGED,
        "zone_chain_csv": _CUSTOMER_STAGED.replace(
            "SELECT c_custkey", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey"
        ),
        "zone_chain_lookup": f"""
            SELECT c_name, sha256(c_name) AS masked_c_name, DATE '{DAY_1}' AS "effectiveDate",
                   'null' AS "updateDate", 'true' AS "current"
            FROM customer""",
        "zone_chain_events": events_staged,
    }
