import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import zonewright.operators.scd2 as scd2
import zonewright.plans.jobs as jobs
from zonewright import JobSpec, Zone, write_zone
from zonewright.__main__ import main
from zonewright.plans.jobs import ingest, raw_to_staging, read_lookup, run_chain
from zonewright.sources import lookup_table

DAY_1, DAY_2, DAY_3 = "2024-01-01", "2024-02-01", "2024-03-01"
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def spec(tmp_path):
    def make(**changes):
        settings = {
            "dataset": "customer",
            "landing": Zone(SF),
            "raw": Zone(str(tmp_path / "raw")),
            "staging": Zone(str(tmp_path / "staging")),
            "masking_cols": ("c_name", "c_mktsegment"),
            "cast_rules": ("c_acctbal:DecimalType:DoubleType:2",),
            "pii_cols": ("c_name",),
            "lookup_path": str(tmp_path / "lookup"),
        }
        return JobSpec(**(settings | changes))

    return make


def test_the_whole_chain(spark, spec, customer):
    staged = run_chain(spark, spec(), "customer.parquet", DAY_1)
    assert staged.columns == [
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
        "c_name",
        "masked_c_mktsegment",
    ]
    raw = customer.orderBy("c_custkey").first()
    row = staged.orderBy("c_custkey").first()
    assert row["c_name"] == sha(raw["c_name"])
    assert row["masked_c_mktsegment"] == sha(raw["c_mktsegment"])
    assert row["c_acctbal"] == Decimal(str(raw["c_acctbal"])).quantize(Decimal("0.01"))
    lookup = read_lookup(spark, spec())
    assert lookup.columns == ["c_name", "masked_c_name", "effectiveDate", "updateDate", "current"]
    assert lookup.count() == 150


def test_a_rerun_raises_instead_of_writing_nothing(spark, spec):
    ingest(spark, spec(), "customer.parquet")
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        ingest(spark, spec(), "customer.parquet")
    raw_to_staging(spark, spec(), "customer.parquet", DAY_1)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        raw_to_staging(spark, spec(), "customer.parquet", DAY_1)


def test_a_zone_is_not_written_onto_itself(spark, spec, tmp_path, customer):
    write_zone(customer, Zone(str(tmp_path / "raw")), "c")
    same = Zone(str(tmp_path / "raw") + "/")
    for job in (ingest, lambda *a: run_chain(*a[:3], DAY_1, a[3])):
        with pytest.raises(ValueError, match="onto itself"):
            job(spark, spec(landing=same), "c", "overwrite")
    with pytest.raises(ValueError, match="onto itself"):
        raw_to_staging(spark, spec(staging=same), "c", DAY_1, mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "raw" / "c")).count() == 150


def test_csv_to_parquet(spark, spec, tmp_path, customer):
    landing = Zone(str(tmp_path / "landing"), "csv")
    write_zone(customer, landing, "c")
    job = spec(
        landing=landing,
        raw=Zone(str(tmp_path / "raw"), "csv"),
        masking_cols=("_c1",),
        pii_cols=("_c1",),
        cast_rules=("_c3:DecimalType:StringType:1",),
        partition_cols=("_c4",),
    )
    staged = run_chain(spark, job, "c", DAY_1)
    assert staged.columns == ["_c0", "_c2", "_c3", "_c1", "_c4"]
    assert len(list((tmp_path / "staging" / "c").glob("_c4=*"))) == 5
    assert staged.count() == 150


def test_staging_as_csv(spark, spec, tmp_path):
    job = spec(staging=Zone(str(tmp_path / "s"), "csv"))
    staged = run_chain(spark, job, "customer.parquet", DAY_1)
    assert staged.columns[-2:] == ["c_name", "masked_c_mktsegment"]
    assert dict(staged.dtypes)["c_acctbal"] == "decimal(10,2)"
    assert staged.where(F.length("c_name") == 64).count() == 150


def test_partition_values_keep_their_type(spark, spec):
    job = spec(
        cast_rules=("c_nationkey:StringType:IntegerType",), partition_cols=("c_nationkey",)
    )
    staged = run_chain(spark, job, "customer.parquet", DAY_1)
    assert dict(staged.dtypes)["c_nationkey"] == "string"


def test_names_in_another_case(spark, spec):
    job = spec(
        masking_cols=("C_Name", "C_MktSegment"),
        pii_cols=("C_Name",),
        cast_rules=("C_AcctBal:DecimalType:DoubleType:2",),
    )
    staged = run_chain(spark, job, "customer.parquet", DAY_1)
    assert staged.columns == [
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
        "C_Name",
        "masked_C_MktSegment",
    ]


def test_rules_for_unknown_columns_raise(spark, spec):
    job = spec(raw=Zone(SF), cast_rules=("nothing:StringType:IntegerType",))
    with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):
        raw_to_staging(spark, job, "customer.parquet", DAY_1)


def test_casts_reach_the_lookup(spark, spec):
    job = spec(
        raw=Zone(SF),
        masking_cols=("c_acctbal",),
        pii_cols=("c_acctbal",),
        cast_rules=("c_acctbal:DecimalType:DoubleType:1", "c_custkey:StringType:LongType"),
        lookup_keys=("c_custkey",),
    )
    raw_to_staging(spark, job, "customer.parquet", DAY_1)
    lookup = read_lookup(spark, job)
    assert lookup.dtypes[:3] == [
        ("c_custkey", "string"),
        ("c_acctbal", "decimal(10,1)"),
        ("masked_c_acctbal", "string"),
    ]
    raw = spark.read.parquet(f"{SF}/customer.parquet").first()
    row = lookup.where(F.col("c_custkey") == str(raw["c_custkey"])).first()
    assert row["masked_c_acctbal"] == sha(str(raw["c_acctbal"]))


def test_a_bad_report_stops_the_chain(spark, spec, tmp_path):
    df = spark.createDataFrame([("a", ["x"]), ("b", None)], "c_name string, l array<string>")
    write_zone(df, Zone(str(tmp_path / "landing")), "t")
    job = spec(
        landing=Zone(str(tmp_path / "landing")),
        masking_cols=("c_name",),
        cast_rules=("l:StringType:ArrayType",),
    )
    with pytest.raises(ValueError, match="data check failed.*'l'"):
        run_chain(spark, job, "t", DAY_1)


def test_a_failed_staging_write_leaves_no_lookup(spark, spec, tmp_path):
    df = spark.createDataFrame([("a", "oops")], "c_name string, n string")
    write_zone(df, Zone(str(tmp_path / "raw")), "t")
    job = spec(masking_cols=("c_name",), cast_rules=("n:DecimalType:StringType:1",))
    with pytest.raises(PySparkException):
        raw_to_staging(spark, job, "t", DAY_1)
    assert read_lookup(spark, job) is None
    raw_to_staging(spark, job, "t", DAY_1, mode="overwrite", on_cast_error="null")
    assert read_lookup(spark, job).count() == 1


def names(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k int, a string, b string")
    write_zone(df, Zone(str(tmp_path / "raw")), "t", mode="overwrite")


@pytest.fixture
def run(spark, spec, tmp_path):
    def go(rows, day, **changes):
        settings = {"masking_cols": ("a", "b"), "pii_cols": ("a", "b"), "cast_rules": ()}
        job = spec(**(settings | changes))
        names(spark, tmp_path, rows)
        raw_to_staging(spark, job, "t", day, mode="overwrite")
        return read_lookup(spark, job)

    return go


@pytest.mark.parametrize("small", [True, False])
def test_dictionary_appends_then_starts_a_generation(run, tmp_path, monkeypatch, small):
    monkeypatch.setattr(scd2, "fits_broadcast", lambda df: small)
    run([(1, "ab", "c"), (2, "x", None)], DAY_1)
    lookup = run([(1, "ab", "c"), (3, "n", "n")], DAY_2)
    assert sorted((r.a, r.b or "", str(r.effectiveDate)) for r in lookup.collect()) == [
        ("ab", "c", DAY_1),
        ("n", "n", DAY_2),
        ("x", "", DAY_1),
        ("x", "", DAY_1),  # keys with a NULL part come twice in the first run
    ]
    root = tmp_path / "lookup"
    assert sorted(p.name for p in (root / "gen=0").iterdir()) == ["add=0", "add=1"]
    lookup = run([(1, "a", "bc")], DAY_3)  # collides with ('ab', 'c')
    assert [r.updateDate for r in lookup.where("a = 'ab'").collect()] == [DAY_3]
    assert lookup.count() == 4
    assert (root / "gen=1" / "add=0" / "_SUCCESS").exists()


@pytest.mark.parametrize("small", [True, False])
def test_dictionary_repeats_raise_unless_dropped(run, monkeypatch, small):
    monkeypatch.setattr(scd2, "fits_broadcast", lambda df: small)
    rows = [(1, "x", "y"), (2, "x", "y")]
    with pytest.raises(ValueError, match="match one lookup row"):
        run(rows, DAY_1)
    assert run(rows, DAY_1, lookup_distinct=True).count() == 1
    with pytest.raises(PySparkException, match="several batch rows"):
        run(rows, DAY_2)
    assert run(rows, DAY_2, lookup_distinct=True).count() == 1


@pytest.mark.parametrize("small", [True, False])
def test_history_over_three_runs(spark, run, tmp_path, monkeypatch, small):
    monkeypatch.setattr(scd2, "fits_broadcast", lambda df: small)
    keyed = {"lookup_keys": ("k",)}
    run([(1, "a", "x"), (2, "b", "y")], DAY_1, **keyed)
    run([(1, "a2", "x"), (3, None, "z")], DAY_2, **keyed)
    lookup = run([(1, "a3", "x"), (2, "b", "y")], DAY_3, **keyed)
    assert sorted((r.k, r.a or "", str(r.updateDate), r.current) for r in lookup.collect()) == [
        (1, "a", DAY_2, False),
        (1, "a2", DAY_3, False),
        (1, "a3", "None", True),
        (2, "b", "None", True),
        (3, "", "None", True),
    ]
    assert lookup.where("a = 'a2'").first()["masked_a"] == sha("a2")
    root = tmp_path / "lookup"
    # Each merge adds only what it closed itself.
    closed = {n: spark.read.parquet(str(root / f"closed={n}")).count() for n in (1, 2)}
    assert closed == {1: 1, 2: 1} and not (root / "closed=0").exists()


def test_history_takes_the_last_row_of_a_key(run):
    keyed = {"lookup_keys": ("k",), "pii_cols": ("a",)}
    rows = [(1, "a", "2"), (1, "z", "1"), (2, "b", "1")]
    with pytest.raises(ValueError, match="occurs 2 times"):
        run(rows, DAY_1, **keyed)
    lookup = run(rows, DAY_1, lookup_order_by=("b",), **keyed)
    assert lookup.columns == ["k", "a", "masked_a", "effectiveDate", "updateDate", "current"]
    assert sorted(lookup.select("k", "a").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="occurs 2 times"):
        run(rows, DAY_2, **keyed)
    assert run(rows, DAY_2, lookup_order_by=("b",), **keyed).count() == 2


def test_keys_brought_together_by_a_cast_are_refused(run):
    keyed = {"lookup_keys": ("b",), "lookup_order_by": ("k",), "pii_cols": ("a",)}
    rows = [(1, "a", "1.01"), (2, "z", "1.02"), (3, "y", "1.02")]
    assert run(rows, DAY_1, **keyed).count() == 2
    rules = ("b:DecimalType:StringType:1",)
    with pytest.raises(ValueError, match="occurs 2 times"):
        run(rows, DAY_2, cast_rules=rules, **keyed)


def test_distinct_values_are_hashed_after_the_shuffle(spark, spec, plan):
    df = spark.createDataFrame([("x", 0.0), ("x", 0.0), ("y", -0.0)], "a string, x double")
    names = spec(masking_cols=("a",), pii_cols=("a",), lookup_distinct=True, cast_rules=())
    above, below = plan(jobs.dictionary_batch(df, names, DAY_1)).split("Exchange")
    assert "masked_a" in above and "masked_a" not in below
    # 0.0 and -0.0 group together, but are two texts and so two masks.
    zeros = spec(masking_cols=("x",), pii_cols=("x",), lookup_distinct=True, cast_rules=())
    assert jobs.dictionary_batch(df, zeros, DAY_1).select("masked_x").distinct().count() == 2


def test_empty_input(run):
    assert run([], DAY_1, lookup_keys=("k",)) is None
    assert run([(1, "a", "x")], DAY_2, lookup_keys=("k",)).count() == 1


def test_appending_needs_a_table(spark, tmp_path):
    with pytest.raises(ValueError, match="no lookup table"):
        lookup_table.append_dictionary(spark, str(tmp_path / "none"), spark.range(1))


def test_measured_size(spark):
    from zonewright.sources.size import fits_broadcast

    df = spark.range(1000).select(F.col("id"), F.repeat(F.lit("x"), 100).alias("s"))
    assert fits_broadcast(df, 1000 * (32 + 100))
    assert not fits_broadcast(df, 1000 * (32 + 100) - 1)
    assert not fits_broadcast(df.select(F.array("s").alias("a")), 1 << 40)
    assert fits_broadcast(df.limit(0), 0)


def test_salt_and_drop_raw_reach_staging(spark, spec):
    ingest(spark, spec(), "customer.parquet")
    staged = raw_to_staging(spark, spec(), "customer.parquet", DAY_1, drop_raw=True, salt="s")
    assert "c_mktsegment" not in staged.columns
    masks = {r["c_name"] for r in staged.collect()}
    assert sha("sCustomer#000000000") in masks


def test_the_chain_can_drop_raw_columns(spark, spec):
    staged = run_chain(spark, spec(), "customer.parquet", DAY_1, drop_raw=True)
    assert "c_mktsegment" not in staged.columns


def test_command_line(spark, tmp_path, capsys):
    config = {
        "ingest-customer": {
            "source": {"file-format": "parquet", "data-location": SF},
            "destination": {"data-location": str(tmp_path / "raw")},
        },
        "mask-customer": {
            "source": {"file-format": "parquet", "data-location": str(tmp_path / "raw")},
            "destination": {"file-format": "parquet", "data-location": str(tmp_path / "staging")},
            "masking-cols": ["c_name"],
            "datatype-update-cols": ["c_acctbal:DecimalType:DoubleType:2"],
            "partition-cols": [],
        },
        "customer-pii-cols": ["c_name"],
        "customer-lookup_dataset": str(tmp_path / "lookup"),
    }
    (tmp_path / "app.json").write_text(json.dumps(config))
    rest = [str(tmp_path / "app.json"), "customer", "customer.parquet"]
    for job in ("ingest", "validate-raw", "stage", "validate-staging"):
        main([job, *rest])
    assert "c_acctbal" in capsys.readouterr().out
    main(["chain", *rest, "--mode", "overwrite", "--as-of", DAY_2])
    spec = JobSpec.from_config(config, "customer")
    assert read_lookup(spark, spec).count() == 150
    write_zone(spark.range(1), spec.raw, "customer.parquet", mode="overwrite")
    with pytest.raises(ValueError, match="data check failed"):
        main(["validate-raw", *rest])


def test_zones_may_not_lie_in_each_other(spark, spec, tmp_path, customer):
    write_zone(customer, Zone(str(tmp_path / "land")), "c")
    land = Zone(f"file:{tmp_path}/./land")
    plain = Zone(str(tmp_path / "land"))
    jobs_of = [
        (ingest, {"landing": land, "raw": plain}),
        (ingest, {"landing": Zone(str(tmp_path)), "raw": Zone(str(tmp_path / "c"))}),
        (lambda *a: run_chain(*a[:3], DAY_1, a[3]), {"landing": land, "staging": plain}),
        (lambda *a: run_chain(*a[:3], DAY_1, a[3]), {"landing": land, "lookup_path": f"{plain.root}/c"}),
    ]
    for job, zones in jobs_of:
        with pytest.raises(ValueError, match="onto itself"):
            job(spark, spec(**zones), "c", "overwrite")
    assert spark.read.parquet(str(tmp_path / "land" / "c")).count() == 150


@pytest.mark.parametrize("raw", ["parquet", "csv"])
@pytest.mark.parametrize("staging", ["parquet", "csv"])
def test_formats_in_every_position(spark, spec, tmp_path, raw, staging):
    job = spec(raw=Zone(str(tmp_path / "r"), raw), staging=Zone(str(tmp_path / "s"), staging))
    staged = run_chain(spark, job, "customer.parquet", DAY_1)
    assert staged.count() == 150 and "masked_c_mktsegment" in staged.columns
    for report in (
        jobs.validate_raw(spark, job, "customer.parquet"),
        jobs.validate_staging(spark, job, "customer.parquet"),
    ):
        assert {r.status for r in report.collect()} == {"success"}


def test_a_failed_check_leaves_the_lookup_as_it_was(spark, spec, tmp_path):
    landing = Zone(str(tmp_path / "land"))
    table = spark.sql("select 1 id, 'x' c_name, cast(null as array<string>) a")
    write_zone(table, landing, "t")
    job = spec(
        landing=landing, masking_cols=("c_name",), cast_rules=("a:StringType:ArrayType",)
    )
    with pytest.raises(ValueError, match="data check failed"):
        run_chain(spark, job, "t", DAY_1)
    assert read_lookup(spark, job) is None
    staged = run_chain(spark, job, "t", DAY_1, "overwrite", may_differ=("A",))
    assert staged.count() == 1 and read_lookup(spark, job).count() == 1


def test_a_new_column_of_some_files_reaches_raw(spark, spec, tmp_path):
    landing = Zone(str(tmp_path / "land"))
    write_zone(spark.sql("select 1 id"), landing, "t")
    write_zone(spark.sql("select 2 id, 'new' z"), landing, "t", "append")
    raw = ingest(spark, spec(landing=landing), "t")
    assert sorted(raw.columns) == ["id", "z"] and raw.where("z = 'new'").count() == 1


def test_the_stored_dictionary_is_read_once(spark, spec, tmp_path, plan):
    from zonewright.operators.dictionary import lookup_projection, match_stored
    from zonewright.operators.masking import mask_columns

    customer = spark.read.parquet(f"{SF}/customer.parquet")
    rows = lookup_projection(mask_columns(customer, ["c_name"]), ["c_name"], DAY_1)
    stored = jobs.lookup_table.replace_dictionary(
        spark, str(tmp_path / "d"), rows.selectExpr("*", "'null' updateDate", "'true' current")
    )
    text = plan(match_stored(spark.read.parquet(stored), rows, ["c_name"]))
    assert text.count("FileScan") == 2 and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 2


def test_an_append_of_nothing_writes_nothing(spark, tmp_path):
    root = str(tmp_path / "d")
    rows = spark.sql("select 1 a")
    lookup_table.replace_dictionary(spark, root, rows)
    lookup_table.append_dictionary(spark, root, rows.where("a = 2"))
    assert len(list((tmp_path / "d" / "gen=0").iterdir())) == 1
    for _ in range(lookup_table.MOST_ADDS):
        lookup_table.append_dictionary(spark, root, rows)
    assert (tmp_path / "d" / "gen=1").exists()
    assert lookup_table.read_dictionary(spark, root).count() == lookup_table.MOST_ADDS + 1


def test_types_in_csv_staging(spark, spec, monkeypatch):
    job = spec(raw=Zone(spec().raw.root, "csv"), staging=Zone(spec().staging.root, "csv"))
    run_chain(spark, job, "customer.parquet", DAY_1)
    report = {r.column_name: (r.n, r.status) for r in jobs.validate_staging_types(spark, job, "customer.parquet").collect()}
    assert report == {"c_acctbal": (150, "success")}
    # a staging written with another scale is refused before the lookup table is touched
    staged = jobs._staged
    monkeypatch.setattr(
        jobs, "_staged", lambda *a: staged(*a).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,3)"))
    )
    with pytest.raises(ValueError, match="decimal scale 2"):
        run_chain(spark, job, "customer.parquet", DAY_2, mode="overwrite")
    assert read_lookup(spark, job).where(f"effectiveDate = '{DAY_2}'").isEmpty()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_values_are_compared_along_the_chain(spark, spec, fmt, monkeypatch):
    job = spec(raw=Zone(spec().raw.root, fmt), staging=Zone(spec().staging.root, fmt))
    assert run_chain(spark, job, "customer.parquet", DAY_1, compare_values=True).count() == 150
    write = jobs.write_zone

    def swapped(df, zone, *args):
        """As many values as before, one of them another."""
        if zone == job.raw:
            df = df.replace({"BUILDING": "MACHINERY"}, subset=["c_mktsegment"])
        return write(df, zone, *args)

    monkeypatch.setattr(jobs, "write_zone", swapped)
    assert run_chain(spark, job, "customer.parquet", DAY_2, mode="overwrite").count() == 150
    with pytest.raises(ValueError, match="c_mktsegment"):
        run_chain(spark, job, "customer.parquet", DAY_2, mode="overwrite", compare_values=True)


LINES = ['1,"x, y",3', "2,b", "3,c,4,5", "q,d,5", "5,,", '6,"say ""hi""",7', ""]
MARKED = "k int, s string, n int"


@pytest.fixture
def broken(tmp_path):
    """A CSV landing zone of three files, one of which is whole."""
    folder = tmp_path / "landing" / "t"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("\n".join(LINES) + "\n")
    (folder / "b.csv").write_text("7,good,1\n8,good,2\n")
    (folder / "c.csv").write_text("9,bad\n10,good,3")
    return Zone(str(tmp_path / "landing"), "csv")


@pytest.mark.parametrize("most", [10_000, 1])
@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_malformed_lines_are_put_aside(spark, spec, broken, tmp_path, monkeypatch, fmt, most):
    monkeypatch.setattr(jobs, "MOST_FILES", most)
    job = spec(landing=broken, raw=Zone(str(tmp_path / "raw"), fmt))
    schema = T.StructType.fromDDL(MARKED)
    good, bad = jobs.ingest_with_quarantine(spark, job, "t", Zone(str(tmp_path / "aside")), schema)
    assert good.columns == ["k", "s", "n"]
    assert sorted((int(r.k), r.s) for r in good.collect()) == [
        (1, "x, y"), (5, None), (6, 'say "hi"'), (7, "good"), (8, "good"), (10, "good")
    ]
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in bad.collect()) == [
        ("a.csv", "2,b", "fields"), ("a.csv", "3,c,4,5", "fields"), ("a.csv", "q,d,5", "type"), ("c.csv", "9,bad", "fields")
    ]
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):  # strict is the default
        ingest(spark, job, "t", mode="overwrite")


def test_text_columns_and_a_whole_dataset(spark, spec, broken, tmp_path):
    job = spec(landing=broken)
    good, bad = jobs.ingest_with_quarantine(spark, job, "t/b.csv", Zone(str(tmp_path / "aside")))
    assert [tuple(r) for r in good.orderBy("_c0").collect()] == [("7", "good", "1"), ("8", "good", "2")]
    assert bad.columns == ["line", "file", "reason"] and bad.isEmpty()
    with pytest.raises(ValueError, match="CSV"):
        jobs.ingest_with_quarantine(spark, spec(), "customer.parquet", Zone(str(tmp_path / "aside")))
