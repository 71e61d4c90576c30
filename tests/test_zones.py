import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from zonewright import Zone, read_zone, write_zone


def test_parquet_round_trip(spark, customer, tmp_path, same_rows):
    zone = Zone(str(tmp_path) + "/")
    path = write_zone(customer, zone, "/a/customer/")
    assert path == f"{tmp_path}/a/customer"
    same_rows(read_zone(spark, zone, "a/customer"), customer)


def test_csv_is_headerless_text(spark, tmp_path):
    zone = Zone(str(tmp_path), "csv")
    df = spark.createDataFrame([("a", 1), ("", 2)], "s string, n int").coalesce(1)
    write_zone(df, zone, "t")
    back = read_zone(spark, zone, "t")
    assert back.dtypes == [("_c0", "string"), ("_c1", "string")]
    assert back.collect() == [("a", "1"), (None, "2")]  # empty text comes back as NULL


def test_csv_with_schema_and_header(spark, tmp_path):
    zone = Zone(str(tmp_path), "csv")
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    write_zone(df, zone, "t", header=True)
    assert read_zone(spark, zone, "t", header=True).columns == ["s", "n"]
    typed = read_zone(spark, zone, "t", schema="s string, n int", header=True)
    assert typed.collect() == [("a", 1)]


def test_csv_cannot_hold_arrays(spark, tmp_path):
    with pytest.raises(AnalysisException):
        write_zone(spark.sql("select array(1) as a"), Zone(str(tmp_path), "csv"), "t")


def test_missing_and_existing_paths_raise(spark, customer, tmp_path):
    zone = Zone(str(tmp_path))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_zone(spark, zone, "nothing")
    write_zone(customer, zone, "c")
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_zone(customer, zone, "c")
    write_zone(customer, zone, "c", mode="overwrite")
    assert read_zone(spark, zone, "c").count() == customer.count()


def test_partitioned_write_prunes_and_keeps_files_few(spark, customer, tmp_path, plan):
    zone = Zone(str(tmp_path))
    wide = customer.repartition(16)
    write_zone(wide, zone, "c", partition_by=["c_mktsegment"])
    back = read_zone(spark, zone, "c")
    assert back.columns[-1] == "c_mktsegment"
    assert sorted(back.select(customer.columns).collect()) == sorted(customer.collect())
    files = [p for p in (tmp_path / "c").glob("c_mktsegment=*/*.parquet")]
    assert len(files) == customer.select("c_mktsegment").distinct().count()
    assert "PartitionFilters: [isnotnull(c_mktsegment" in plan(
        back.where(F.col("c_mktsegment") == "BUILDING")
    )


def test_partitioned_write_splits_a_hot_value(spark, tmp_path):
    """Half of all rows share one value: more than one task writes it."""
    zone = Zone(str(tmp_path))
    df = spark.range(200_000).select(
        F.when(F.col("id") < 100_000, -1).otherwise(F.col("id") % 4).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_zone(df.repartition(8), zone, "t", partition_by=["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "k=-1").glob("*.parquet"))) > 1
    assert read_zone(spark, zone, "t").count() == 200_000


def test_partitioned_write_without_a_shuffle(spark, customer, tmp_path, same_rows):
    zone = Zone(str(tmp_path))
    write_zone(customer, zone, "c", partition_by=["c_mktsegment"], rebalance=False)
    same_rows(read_zone(spark, zone, "c").select(customer.columns), customer)


AWKWARD = [
    ("  x ", 1), ('say "so", then', 2), ("back\\slash \\", 3), ("", 4), (None, 5), ("a,b", 6),
    ("\\", 7), ('"', 8), ("é\t", 9), ("#", 10),
]


def test_csv_keeps_every_text(spark, tmp_path, same_rows):
    zone = Zone(str(tmp_path), "csv", null_text="NULL!")
    df = spark.createDataFrame(AWKWARD, "s string, n int")
    write_zone(df, zone, "t")
    same_rows(read_zone(spark, zone, "t", df.schema), df)
    with pytest.raises(PySparkException, match="text for NULL"):
        write_zone(spark.createDataFrame([("NULL!", 1)], df.schema), zone, "u")


def test_csv_with_line_breaks(spark, tmp_path, same_rows):
    df = spark.createDataFrame([("a\nb", 1), ("c\r\nd\n", 2), ('"\n,', 3)], "s string, n int")
    with pytest.raises(PySparkException, match="line break"):
        write_zone(df, Zone(str(tmp_path), "csv"), "t")
    zone = Zone(str(tmp_path), "csv", multi_line=True)
    write_zone(df, zone, "u")
    same_rows(read_zone(spark, zone, "u", df.schema), df)


@pytest.mark.parametrize("line", ["b,2,LOST", "b"])
def test_csv_lines_of_another_length_raise(spark, tmp_path, line):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part.csv").write_text(f"a,1\n{line}\n")
    zone = Zone(str(tmp_path), "csv")
    for columns in (["_c0"], ["_c0", "_c1"]):
        with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
            read_zone(spark, zone, "t").select(columns).collect()


def test_columns_of_all_parquet_files(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t" / "p=1"))
    spark.sql("select 5L id, 7 z").write.parquet(str(tmp_path / "t" / "p=2"))
    both = read_zone(spark, Zone(str(tmp_path)), "t", merge_schema=True)
    assert set(both.columns) == {"id", "z", "p"} and both.where("z = 7").count() == 1


def test_null_in_a_single_csv_column(spark, tmp_path):
    with pytest.raises(PySparkException, match="one column"):
        write_zone(spark.sql("select cast(null as string) a"), Zone(str(tmp_path), "csv"), "t")
