import hashlib

import pytest
from pyspark.sql import functions as F

from zonewright import mask_columns, pii_swap


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_hash_is_lower_case_hex_of_utf8_and_null_stays_null(spark):
    df = spark.createDataFrame([("é",), ("",), (None,)], "c string")
    got = [r["masked_c"] for r in mask_columns(df, ["c"]).collect()]
    assert got == [sha("é"), sha(""), None]
    assert got[1].startswith("e3b0c442")


def test_other_atomic_types_hash_their_text(spark):
    df = spark.sql("select 7 i, cast(1.50 as decimal(5,2)) d, true b, date'2024-01-02' t")
    row = mask_columns(df, df.columns).first()
    assert row["masked_i"] == sha("7")
    assert row["masked_d"] == sha("1.50")
    assert row["masked_b"] == sha("true")
    assert row["masked_t"] == sha("2024-01-02")


def test_binary_is_hashed_as_it_is(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x00"),)], "c binary")
    assert mask_columns(df, ["c"]).first()["masked_c"] == hashlib.sha256(b"\xff\x00").hexdigest()
    salted = mask_columns(df, ["c"], salt="s").first()["masked_c"]
    assert salted == hashlib.sha256(b"s\xff\x00").hexdigest()


def test_nested_types_are_refused(spark):
    df = spark.sql("select array('a') as c")
    with pytest.raises(TypeError):
        mask_columns(df, ["c"])


def test_salt_goes_before_the_value(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert [r["masked_c"] for r in mask_columns(df, ["c"], salt="pepper").collect()] == [
        sha("peppera"),
        None,
    ]


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([("a", 1)], "`x.y` string, n int")
    swapped = pii_swap(mask_columns(df, ["x.y"]), ["x.y"], ["x.y"])
    assert swapped.columns == ["n", "x.y"]
    assert swapped.first()["x.y"] == sha("a")


def test_no_columns_to_mask(customer):
    assert mask_columns(customer, []).columns == customer.columns


def test_swap_order_and_leftover_raw_column(customer):
    cols = ["c_mktsegment", "c_name"]
    swapped = pii_swap(mask_columns(customer, cols), cols, ["c_name"])
    assert swapped.columns == [
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
        "masked_c_mktsegment",
        "c_name",
    ]
    assert swapped.where(F.length("c_name") != 64).count() == 0


def test_swap_can_drop_every_raw_column(customer):
    cols = ["c_mktsegment", "c_name"]
    swapped = pii_swap(mask_columns(customer, cols), cols, ["c_name"], drop_raw=True)
    assert swapped.columns == [
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        "masked_c_mktsegment",
        "c_name",
    ]


def test_pii_must_be_masked(customer):
    with pytest.raises(ValueError, match="without a mask"):
        pii_swap(mask_columns(customer, ["c_name"]), ["c_name"], ["c_acctbal"])


def test_masking_reads_only_what_is_asked_for(customer, plan):
    text = plan(mask_columns(customer, ["c_name"]).select("masked_c_name"))
    assert "ReadSchema: struct<c_name:string>" in text
    assert "Exchange" not in text and "Python" not in text


def test_names_are_compared_as_the_session_does(spark):
    df = spark.createDataFrame([("a", "b")], "Name string, Town string")
    swapped = pii_swap(mask_columns(df, ["name", "name"]), ["name", "name"], ["NAME"])
    assert swapped.columns == ["Town", "name"]
    assert swapped.first()["name"] == sha("a")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="without a mask"):
            pii_swap(mask_columns(df, ["Name"]), ["Name"], ["name"])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_masks_of_instants_do_not_depend_on_the_session(spark):
    from zonewright import mask_columns

    def masks():
        df = spark.sql("select timestamp_micros(id * 123456789012345L) t from range(-3, 9)")
        return [r.masked_t for r in mask_columns(df, ["t"]).collect()]

    utc = masks()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert masks() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    plain = spark.sql("select sha2(string(timestamp_micros(id * 123456789012345L)), 256) h from range(-3, 9)")
    assert [r.h for r in plain.collect()] == utc
