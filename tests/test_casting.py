from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import types as T

from zonewright import CastRule, cast_columns


def values(df, name="x"):
    return [r[name] for r in df.collect()]


def test_decimal_rounds_half_up_on_the_shortest_text(spark):
    df = spark.createDataFrame([(1.005,), (-2.345,), (None,)], "x double")
    out = cast_columns(df, ["x:DecimalType:DoubleType:2"])
    assert out.schema["x"].dataType == T.DecimalType(10, 2)
    assert values(out) == [Decimal("1.01"), Decimal("-2.35"), None]


@pytest.mark.parametrize("bad", ["123456789.5", "abc"])
def test_bad_values_raise_or_become_null(spark, bad):
    df = spark.createDataFrame([(bad,), ("1",)], "x string")
    with pytest.raises(PySparkException):
        cast_columns(df, ["x:DecimalType:StringType:3"]).collect()
    out = cast_columns(df, ["x:DecimalType:StringType:3"], on_error="null")
    assert values(out) == [None, Decimal("1.000")]


def test_precision_is_open_to_code(spark):
    df = spark.createDataFrame([("123456789012.5",)], "x string")
    out = cast_columns(df, [CastRule("x", "decimal", scale=1, precision=20)])
    assert values(out) == [Decimal("123456789012.5")]


def test_arrays_become_comma_separated_text(spark):
    df = spark.createDataFrame(
        [(["a", "b"],), (None,), ([],), (["a", None, "b"],), (["a,b", "c"],)], "x array<string>"
    )
    out = cast_columns(df, ["x:StringType:ArrayType"])
    assert values(out) == ["a,b", "", "", "a,b", "a,b,c"]


def test_arrays_of_numbers(spark):
    df = spark.createDataFrame([([1, 2],)], "x array<int>")
    assert values(cast_columns(df, ["x:StringType:ArrayType"])) == ["1,2"]


def test_arrays_of_structs_are_refused(spark):
    df = spark.sql("select array(struct(1 as a)) as x")
    with pytest.raises(AnalysisException):
        cast_columns(df, ["x:StringType:ArrayType"])


def test_rules_on_one_column_apply_in_order(spark):
    df = spark.createDataFrame([(1.005,)], "x double")
    out = cast_columns(df, ["x:DecimalType:DoubleType:1", "x:StringType:DecimalType"])
    assert values(out) == ["1.0"]


def test_columns_stay_in_place_and_others_pass_through(spark):
    df = spark.sql("select 1 as a, 2.5D as x, map('k', 1) as m")
    out = cast_columns(df, ["x:StringType:DoubleType"])
    assert out.columns == ["a", "x", "m"]
    assert out.schema["m"].dataType == df.schema["m"].dataType


def test_unknown_column_and_unknown_policy_raise(spark):
    df = spark.sql("select 1 as a")
    with pytest.raises(AnalysisException):
        cast_columns(df, ["b:StringType:IntegerType"])
    with pytest.raises(ValueError):
        cast_columns(df, [], on_error="ignore")


def test_one_projection_inside_codegen(spark, plan):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = ["l_tax:DecimalType:DoubleType:2", "l_discount:DecimalType:DoubleType:2"]
    text = plan(cast_columns(df, rules).select("l_tax"))
    assert text.count("Project") == 1
    assert "ReadSchema: struct<l_tax:double>" in text
