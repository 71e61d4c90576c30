"""Joins with frequent keys."""

import pytest
from pyspark.sql import functions as F

from zonewright import lookup_bootstrap, lookup_projection, lookup_upsert, mask_columns
from zonewright.operators import dictionary
from zonewright.operators.dictionary import match_stored, unseen_rows, updated_rows
from zonewright.operators.heavy import heavy_keys, spread_join


@pytest.fixture
def plain_shuffles(spark):
    """Neither adaptive execution nor broadcasts; 16 partitions."""
    conf = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark, n=60_000):
    """A third of the rows have one key, a tenth another, the rest one each."""
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 10 == 1, -2).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(F.nullif(key, F.lit(5)).alias("k"), (F.col("id") % 50).alias("v"))


def largest(df):
    return max(n for _, n in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_heavy_keys(spark):
    found = heavy_keys(skewed(spark), ["k"])
    names = {spark.range(1).select(F.xxhash64(F.lit(k).cast("long"))).first()[0]: k for k in (-1, -2)}
    assert {names[h]: n for h, n in found.items()} == {-1: 34, -2: 7}
    assert heavy_keys(spark.range(1000), ["id"]) == {}
    assert heavy_keys(spark.range(0), ["id"]) == {}
    assert heavy_keys(spark.range(9).select(F.lit(None).cast("int").alias("k")), ["k"]) == {}
    with pytest.raises(ValueError, match="share"):
        heavy_keys(spark.range(9), ["id"], share=0.001)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_in_bounded_partitions(spark, plain_shuffles, same_rows, how):
    left = skewed(spark)
    right = spark.createDataFrame([(-1, "a"), (-1, "b"), (4, "c"), (70_000, "d"), (None, "e")], "k long, w string")
    want = left.join(right, "k", how)
    found = spread_join(left, right, ["k"], how)
    same_rows(found, want)
    if how == "left":
        # twice 20,000 rows have one key and sat in one of 16 tasks
        assert largest(want) > 40_000 and largest(found) < 15_000
    with pytest.raises(ValueError, match="cannot spread"):
        spread_join(left, right, ["k"], "full")


def test_keys_of_several_columns_and_no_heavy_one(spark, same_rows):
    left = spark.range(100).selectExpr("id % 7 a", "string(id) b", "map(1, id) m")
    right = spark.range(50).selectExpr("id % 7 a", "string(id) b", "id c")
    joined = spread_join(left, right, ["a", "b"], "left").drop("m")
    same_rows(joined, left.join(right, ["a", "b"], "left").drop("m"))


def values(spark, hot, day):
    value = F.when(F.col("id") % 3 == 0, hot).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 60_000, 1, 8).select(value.alias("a"))
    return lookup_projection(mask_columns(rows, ["a"]), ["a"], day)


@pytest.mark.parametrize("small", [True, False])
def test_a_hot_stored_value(spark, plain_shuffles, same_rows, monkeypatch, small):
    """A third of the stored rows have one value, whose mask differs from that of the batch."""
    monkeypatch.setattr(dictionary, "fits_broadcast", lambda df: small)
    stored = lookup_bootstrap(values(spark, "hot", "2024-01-01"))
    batch = lookup_projection(
        spark.createDataFrame([("hot", "other"), ("new", "n"), ("1", "other")], "a string, masked_a string"),
        ["a"], "2024-02-01",
    )
    matches = match_stored(stored, batch, ["a"])
    kept = updated_rows(stored, batch, matches, ["a"], "2024-02-01")
    assert kept.where("updateDate = '2024-02-01'").count() == 20_001
    assert largest(kept) < 12_000
    new = unseen_rows(batch, matches, ["a"], "2024-02-01")
    assert [r.a for r in new.collect()] == ["new"]
    merged = lookup_upsert(stored, batch, ["a"], "2024-02-01")
    same_rows(merged, kept.unionByName(new))
