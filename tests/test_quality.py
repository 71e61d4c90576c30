import pytest
from pyspark.sql import functions as F

from zonewright import (
    assert_passed,
    cast_columns,
    check_text_types,
    check_types,
    mask_columns,
    non_null_counts,
    pii_swap,
    reconcile,
    reconcile_values,
)
from zonewright.operators.quality import observe_counts


def lines(report):
    return {r["column_name"]: tuple(r)[1:] for r in report.collect()}


def counts(df):
    return dict(non_null_counts(df).collect())


def test_counts_skip_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, "a"), (float("nan"), float("nan"), None), (None, None, "")],
        "d double, f float, s string",
    )
    assert counts(df) == {"*": 3, "d": 1, "f": 1, "s": 2}


def test_counts_of_an_empty_table(spark):
    df = spark.createDataFrame([], "d double, s string")
    assert counts(df) == {"*": 0, "d": 0, "s": 0}


def test_equal_tables_pass(customer):
    report = reconcile(customer, customer)
    assert set(lines(report)) == {"*", *customer.columns}
    assert_passed(report)


def test_lost_rows_and_lost_values_fail(customer):
    report = lines(reconcile(customer, customer.where("c_acctbal > 0")))
    assert report["*"][2] == "failed"
    holes = customer.withColumn("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    report = lines(reconcile(customer, holes))
    assert report["*"][2] == "success"
    assert report["c_name"][2] == "failed"
    assert report["c_acctbal"][2] == "success"


def test_missing_columns_show_on_both_sides(customer):
    target = customer.drop("c_name").withColumn("extra", F.lit(1))
    report = lines(reconcile(customer, target))
    assert report["c_name"] == (150, None, "missing_in_target")
    assert report["extra"] == (None, 150, "missing_in_source")
    with pytest.raises(ValueError, match="missing_in_target"):
        assert_passed(reconcile(customer, target))


def test_staging_maps_masks_to_their_columns(customer):
    cols = ["c_name", "c_mktsegment"]
    staged = pii_swap(mask_columns(customer, cols), cols, ["c_name"])
    report = reconcile(customer, staged, masked=True, compare_rows=False)
    assert lines(report)["masked_c_mktsegment"] == (150, 150, "success")
    assert_passed(report)


def test_staging_must_not_be_empty(customer):
    report = lines(reconcile(customer, customer.limit(0), compare_rows=False))
    assert report["*"] == (150, 0, "failed")


def test_null_arrays_and_failed_casts_are_seen(spark):
    raw = spark.createDataFrame([(["a"], "1"), (None, "x")], "a array<string>, n string")
    rules = ["a:StringType:ArrayType", "n:DecimalType:StringType:1"]
    staged = cast_columns(raw, rules, on_error="null")
    report = lines(reconcile(raw, staged, masked=True, compare_rows=False))
    assert report["a"] == (1, 2, "failed")  # a NULL array became ''
    assert report["n"] == (2, 1, "failed")


def test_type_checks(spark):
    df = spark.sql("select cast(1 as decimal(12,2)) d, 'x' s, 1 i, cast(null as string) z")
    rules = [
        "d:DecimalType:x:2",
        "s:StringType:x",
        "i:StringType:x",
        "z:StringType:ArrayType",
        "gone:DecimalType:x:1",
    ]
    assert lines(check_types(df, rules)) == {
        "d": ("decimal scale 2", "decimal(12,2)", 1, "success"),
        "s": ("string", "string", 1, "success"),
        "i": ("string", "int", 1, "failed"),
        "z": ("string", "string", 0, "success"),
        "gone": ("decimal scale 1", "missing", 0, "failed"),
    }
    assert lines(check_types(df, ["d:DecimalType:x:3"]))["d"][3] == "failed"
    with pytest.raises(ValueError):
        check_types(df, [])


def test_the_last_rule_on_a_column_counts(spark):
    rules = ["d:DecimalType:x:2", "d:StringType:x"]
    df = cast_columns(spark.sql("select 1.5D as d"), rules)
    assert_passed(check_types(df, rules))


def test_one_pass_over_a_table(customer, plan):
    text = plan(non_null_counts(customer))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1  # one row per task


def test_counts_taken_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None)], "d double, s string")
    observed, report = observe_counts(df)
    observed.write.parquet(str(tmp_path / "t"))
    assert dict(report().collect()) == counts(df) == {"*": 2, "d": 1, "s": 1}


def test_type_checks_without_reading(spark, plan):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    report = check_types(df, ["o_orderkey:StringType:x"], count_values=False)
    assert lines(report) == {"o_orderkey": ("string", "bigint", None, "failed")}
    assert "FileScan" not in plan(report)


@pytest.fixture
def footers(spark):
    """A session that answers plain counts from parquet footers."""
    spark.conf.set("spark.sql.sources.useV1SourceList", "csv,json")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    yield
    spark.conf.unset("spark.sql.sources.useV1SourceList")
    spark.conf.unset("spark.sql.parquet.aggregatePushdown")


def test_counts_from_footers(spark, footers, plan, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, float("nan")), (None, "c", None)], "i int, s string, d double"
    )
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    report = non_null_counts(back)
    assert dict(report.collect()) == {"*": 3, "i": 2, "s": 2, "d": 1}
    text = plan(report)
    assert "PushedAggregation: [COUNT(*), COUNT(i), COUNT(s)]" in text
    assert "ReadSchema: struct<d:double>" in text  # floats are read, for their NaN


def test_nested_columns_are_never_counted_from_footers(spark, footers, plan, tmp_path):
    df = spark.createDataFrame(
        [([1, None], (None,), "x"), (None, (2,), None), ([], None, "y")],
        "a array<int>, b struct<c: int>, s string",
    )
    df.write.parquet(str(tmp_path / "t"))
    report = non_null_counts(spark.read.parquet(str(tmp_path / "t")))
    assert dict(report.collect()) == {"*": 3, "a": 2, "b": 2, "s": 2}
    assert "PushedAggregation: [COUNT" not in plan(report)



def test_values_that_counts_cannot_tell(spark):
    schema = "k int, s string, x double, a array<int>"
    rows = [(1, "a", 0.0, [1, None]), (2, None, float("nan"), []), (3, "c", None, None)]
    source = spark.createDataFrame(rows, schema)
    same = source.repartition(3).orderBy(F.desc("k")).withColumn("x", -F.col("x"))
    assert {s for *_, s in lines(reconcile_values(source, same)).values()} == {"success"}

    def status(changed):
        found = lines(reconcile_values(source, spark.createDataFrame(changed, schema)))
        return {name for name, (*_, s) in found.items() if s != "success"}

    moved = [(1, None, 0.0, [1, None]), (2, "a", float("nan"), []), (3, "c", None, None)]
    assert status(moved) == {"*"}
    altered = [(1, "a", 0.0, [None, 1]), (2, None, None, []), (3, "b", None, None)]
    assert status(altered) == {"*", "s", "x", "a"}
    assert status(rows + rows[:1]) == {"*", "k", "s", "x", "a"}
    assert status([(1, "a", 0.0, [1, None]), (2, None, float("nan"), None), (3, "c", None, [])]) == {"*"}
    assert status([]) == {"*", "k", "s", "x", "a"}


def test_values_of_other_types_and_columns(spark):
    source = spark.createDataFrame([(1, "1.50", "x"), (2, "oops", "y")], "k int, v string, own string")
    target = spark.createDataFrame([("1", 1.5, 0), ("2", None, 0)], "K string, v double, more int")
    report = reconcile_values(source, target)
    assert {n: s for n, (*_, s) in lines(report).items()} == {
        "*": "success", "K": "success", "v": "success", "own": "missing_in_target", "more": "missing_in_source",
    }
    with pytest.raises(ValueError, match="missing_in_target"):
        assert_passed(report)
    none = source.select("own").limit(0)
    assert lines(reconcile_values(none, none)) == {"*": ("0", "0", "success"), "own": ("0", "0", "success")}


def test_value_sums_are_partial_in_every_task(spark, plan):
    source = spark.range(0, 1000, 1, 8).selectExpr("id", "string(id) s")
    text = plan(reconcile_values(source, source))
    assert text.count("partial_sum") >= 2 and "hashpartitioning(id" not in text and "Python" not in text


def test_types_of_text(spark):
    text = spark.createDataFrame(
        [("1.50", "1.5", "007", "x"), ("-0.10", "1e3", "7", None), (None, "12345678901.00", "", "")],
        "good string, bad string, lead string, s string",
    )
    rules = ["good:DecimalType:x:2", "bad:DecimalType:x:2", "lead:DecimalType:x:0", "s:StringType:x", "none:StringType:x"]
    assert lines(check_text_types(text, rules)) == {
        "good": ("decimal scale 2", "text", 2, "success"),
        "bad": ("decimal scale 2", "text", 0, "failed"),
        "lead": ("decimal scale 0", "text", 1, "failed"),
        "s": ("string", "text", 2, "success"),
        "none": ("string", "missing", 0, "failed"),
    }
    assert lines(check_text_types(text, rules[2:3], null_text="007"))["lead"][2:] == (1, "failed")
    assert lines(check_text_types(text.limit(0), rules[:1]))["good"][2:] == (0, "success")
    with pytest.raises(ValueError, match="no cast rules"):
        check_text_types(text, [])
