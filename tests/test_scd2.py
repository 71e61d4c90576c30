import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from zonewright import detect_changes, mask_columns, scd2_merge, scd2_open, stage_updates
from zonewright.operators.scd2 import latest_per_key, lookup_as_of, scd2_changes

DAY_1, DAY_2, DAY_3 = dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)
COLS = ["c_custkey", "c_name", "c_mktsegment"]
KEYS, TRACKED = COLS[:1], COLS[1:]
BOTH = pytest.mark.parametrize("broadcast", [False, True])

# sf -> initial, batch, changed, new, rows and open versions after the merge
GOLDEN = {
    "sf0.001": (135, 50, 20, 5, 160, 140),
    "sf0.01": (1350, 500, 200, 50, 1600, 1400),
}


def golden(spark, sf):
    """Nine tenths of the customers stored, a third arriving, half of those changed."""
    customer = spark.read.parquet(f"/root/testdata/{sf}/customer.parquet").select(COLS)
    stored = scd2_open(customer.where("c_custkey % 10 <> 0"), DAY_1)
    segment = F.when(F.col("c_custkey") % 2 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    batch = customer.where("c_custkey % 3 = 0").withColumn("c_mktsegment", segment)
    return stored, batch


@BOTH
@pytest.mark.parametrize("sf", GOLDEN)
def test_golden_scenario(spark, sf, broadcast, same_rows):
    initial, arriving, changed, new, rows, still_open = GOLDEN[sf]
    stored, batch = golden(spark, sf)
    assert (stored.count(), batch.count()) == (initial, arriving)
    assert detect_changes(stored, batch, KEYS, TRACKED).count() == changed

    merged = scd2_merge(stored, batch, KEYS, TRACKED, DAY_2, broadcast_batch=broadcast)
    assert merged.schema.names == stored.schema.names
    assert merged.count() == rows == initial + changed + new
    assert merged.where("current").count() == still_open
    closed = merged.where("not current")
    assert closed.where(F.col("updateDate") == DAY_2).count() == closed.count() == changed
    opened = merged.where(F.col("effectiveDate") == DAY_2)
    assert opened.where("current and updateDate is null").count() == changed + new
    assert merged.where("current").groupBy(KEYS).count().where("count > 1").count() == 0

    replayed = scd2_merge(merged, batch, KEYS, TRACKED, DAY_3, broadcast_batch=broadcast)
    same_rows(replayed, merged)
    outside = merged.join(batch, KEYS, "left_anti").select(merged.columns)
    same_rows(outside, stored.join(batch, KEYS, "left_anti").select(merged.columns))


def test_stage_updates_golden(spark):
    stored, batch = golden(spark, "sf0.01")
    staged = stage_updates(detect_changes(stored, batch, KEYS, TRACKED), batch, KEYS)
    assert staged.columns == ["mergeKey", *COLS]
    assert dict(staged.dtypes)["mergeKey"] == "string"
    assert staged.count() == 700
    assert staged.where("mergeKey is null").count() == 200
    assert staged.where("mergeKey = cast(c_custkey as string)").count() == 500


def model(history, batch, day):
    """What a merge must give, row by row."""
    arriving = {key: values for key, values in batch}
    out, known = [], {}
    for key, values, opened, closed, current in history:
        if current:
            known[key] = values
        if current and key in arriving and arriving[key] != values:
            out.append((key, values, opened, day, False))
        else:
            out.append((key, values, opened, closed, current))
    for key, values in batch:
        if key not in known or known[key] != values:
            out.append((key, values, day, None, True))
    return out


text = st.sampled_from([None, "", "a", "b"])
sides = st.dictionaries(st.sampled_from([None, 1, 2, 3]), st.tuples(text, text), max_size=4)
worlds = st.lists(st.tuples(sides, sides, sides), min_size=30, max_size=40)


@given(worlds)
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@BOTH
def test_against_the_model(spark, broadcast, worlds):
    """Many small worlds in one run, told apart by the first key column. Keys and values may
    be NULL, and the second merge sees a history."""

    def frame(side):
        rows = [(w, k, *v) for w, world in enumerate(worlds) for k, v in world[side].items()]
        return spark.createDataFrame(rows, "w int, k int, a string, b string")

    def merge(lookup, side, day):
        return scd2_merge(lookup, frame(side), ["w", "k"], ["a", "b"], day, (), broadcast)

    merged = merge(merge(scd2_open(frame(0), DAY_1), 1, DAY_2), 2, DAY_3)
    want = []
    for w, world in enumerate(worlds):
        first, second, third = ([((w, k), v) for k, v in side.items()] for side in world)
        history = [(k, v, DAY_1, None, True) for k, v in first]
        want += model(model(history, second, DAY_2), third, DAY_3)
    got = Counter(((r.w, r.k), (r.a, r.b), *r[4:]) for r in merged.collect())
    assert got == Counter(want)


@BOTH
def test_change_to_and_from_null(spark, broadcast):
    stored = scd2_open(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), DAY_1)
    batch = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    merged = scd2_merge(stored, batch, ["k"], ["v"], DAY_2, broadcast_batch=broadcast)
    assert sorted(merged.where("current").select("k", "v").collect()) == [(1, None), (2, "b")]
    assert merged.count() == 4


@BOTH
def test_duplicate_keys_in_the_batch(spark, broadcast):
    stored = scd2_open(spark.createDataFrame([(9, "z", 0)], "k int, v string, at int"), DAY_1)
    batch = spark.createDataFrame(
        [(1, "old", 1), (1, "new", 2), (2, "x", None), (2, "y", 5)], "k int, v string, at int"
    )
    for lookup in (stored, scd2_open(batch.where("v = 'old'"), DAY_1)):
        with pytest.raises(PySparkException, match="more than once"):
            scd2_merge(lookup, batch, ["k"], ["v"], DAY_2, broadcast_batch=broadcast).count()
    merged = scd2_merge(stored, batch, ["k"], ["v"], DAY_2, ["at"], broadcast)
    assert sorted(merged.select("k", "v", "at").collect()) == [
        (1, "new", 2),
        (2, "y", 5),
        (9, "z", 0),
    ]


@BOTH
def test_rows_of_unknown_status_are_kept(spark, broadcast):
    stored = scd2_open(spark.createDataFrame([(1, "a")], "k int, v string"), DAY_1)
    stored = stored.withColumn("current", F.lit(None).cast("boolean"))
    batch = spark.createDataFrame([(1, "b")], "k int, v string")
    merged = scd2_merge(stored, batch, ["k"], ["v"], DAY_2, broadcast_batch=broadcast)
    unknown = merged.select("v", F.col("current").isNull())
    assert sorted(unknown.collect()) == [("a", True), ("b", False)]


def test_two_open_versions_of_one_key_are_an_error(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c")], "k int, v string")
    with pytest.raises(PySparkException, match="more than once"):
        scd2_merge(scd2_open(twice, DAY_1), batch, ["k"], ["v"], DAY_2).count()


def test_filters_on_the_result_do_not_trip_the_check(spark):
    stored, batch = golden(spark, "sf0.001")
    merged = scd2_merge(stored, batch, KEYS, TRACKED, DAY_2)
    assert merged.where("not current").count() == 20
    assert merged.where("current and updateDate is null").count() == 140
    assert merged.where("c_custkey = 6").count() == 2


@BOTH
def test_untracked_columns_ride_along(spark, broadcast):
    first = spark.createDataFrame([(1, "a", 1.0)], "k int, v string, x double")
    stored = scd2_open(mask_columns(first, ["v"]), DAY_1)
    batch = mask_columns(
        spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k int, v string, x double"), ["v"]
    )
    merged = scd2_merge(stored, batch, ["k"], ["v"], DAY_2, broadcast_batch=broadcast)
    assert sorted(merged.select("k", "x").collect()) == [(1, 1.0), (2, 3.0)]


@BOTH
def test_empty_sides(spark, broadcast, same_rows):
    some = spark.createDataFrame([(1, "a")], "k int, v string")
    none = some.limit(0)
    opened = scd2_merge(scd2_open(none, DAY_1), some, ["k"], ["v"], DAY_2, (), broadcast)
    same_rows(opened, scd2_open(some, DAY_2))
    kept = scd2_merge(scd2_open(some, DAY_1), none, ["k"], ["v"], DAY_2, (), broadcast)
    same_rows(kept, scd2_open(some, DAY_1))


def test_one_shuffle_of_each_side(spark, plan, tmp_path):
    stored, batch = golden(spark, "sf0.001")
    stored.write.parquet(str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    text = plan(scd2_merge(stored, batch, KEYS, TRACKED, DAY_2))
    assert text.count("Exchange hashpartitioning") == 1  # the union of both sides
    assert text.count("+- Sort ") == 1
    assert "Join" not in text and "Python" not in text
    assert text.count("/l]") == 1


@BOTH
def test_a_chain_of_merges_reads_each_table_once(spark, plan, tmp_path, broadcast):
    """Scans grow by one per merge, that of its batch, or by three small stored ones."""
    history, batch = golden(spark, "sf0.001")
    history.write.parquet(str(tmp_path / "l"))
    history = spark.read.parquet(str(tmp_path / "l"))
    scans = []
    for day in ("2024-03-01", "2024-04-01", "2024-05-01"):
        history = scd2_merge(history, batch, KEYS, TRACKED, day, broadcast_batch=broadcast)
        text = plan(history)
        assert text.count("/l]") == 1
        scans.append(text.count("FileScan"))
    steps = {b - a for a, b in zip(scans, scans[1:], strict=False)}
    assert steps == {3 if broadcast else 1}


def test_closed_versions_of_a_key_are_spread(spark):
    """A key with a long history is not one group of the exchange."""
    schema = "k int, v string, effectiveDate date, updateDate date, current boolean"
    rows = spark.range(20_000).selectExpr(
        "1 k", "string(id) v", "date_add(date'1970-01-01', int(id)) effectiveDate",
        "date_add(date'1970-01-02', int(id)) updateDate", "false current",
    )
    batch = spark.createDataFrame([(1, "new")], "k int, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = scd2_merge(rows, batch, ["k"], ["v"], "2099-01-01")
        sizes = [n for _, n in merged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_001 and max(sizes) < 7_000
    assert spark.createDataFrame([], schema).columns == merged.columns


@BOTH
def test_only_the_changes(spark, broadcast):
    """Two closed versions and three new ones of a merge that leaves most rows alone."""
    stored, batch = golden(spark, "sf0.001")
    merged = scd2_merge(stored, batch, KEYS, TRACKED, DAY_2, broadcast_batch=broadcast)
    changes = scd2_changes(stored, batch, KEYS, TRACKED, DAY_2, broadcast_batch=broadcast)
    assert changes.columns == merged.columns
    want = merged.exceptAll(stored)
    assert changes.exceptAll(want).count() == want.exceptAll(changes).count() == 0
    assert 0 < changes.count() < merged.count()


def test_broadcast_leaves_the_lookup_unshuffled(spark, plan, tmp_path):
    stored, batch = golden(spark, "sf0.001")
    stored.write.parquet(str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    text = plan(scd2_merge(stored, batch, KEYS, TRACKED, DAY_2, broadcast_batch=True))
    assert "SortMergeJoin" not in text and "NestedLoop" not in text
    # The only exchanges count the batch's keys.
    for part in text.split("Exchange hashpartitioning")[1:]:
        assert "/l]" not in part.split("BroadcastHashJoin")[0]


def test_many_rows_of_a_key_are_reduced_before_the_shuffle(spark, plan):
    hot = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
    batch = spark.range(0, 30_000, 1, 8).select(hot.alias("k"), F.col("id").alias("at"))
    last = latest_per_key(batch, ["k"], ["at"])
    below = plan(last).split("Exchange")[1]
    assert "partial_max" in below
    assert last.where("k = -1").collect() == [(-1, 29_997)]
    assert last.count() == 20_001


@BOTH
def test_two_open_versions_of_a_key_are_refused(spark, broadcast):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "c", "x")]
    stored = scd2_open(spark.createDataFrame(rows, "c_custkey int, c_name string, c_mktsegment string"), DAY_1)
    for batch in ([(1, "d", "x")], [(1, "a", "x")]):
        batch = spark.createDataFrame(batch, stored.schema[:3])
        with pytest.raises(PySparkException, match="more than once"):
            scd2_merge(stored, batch, KEYS, TRACKED, DAY_2, broadcast_batch=broadcast).collect()


@BOTH
def test_a_merge_before_the_open_version_is_refused(spark, broadcast):
    schema = "c_custkey int, c_name string, c_mktsegment string"
    stored = scd2_open(spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], schema), DAY_2)
    late = spark.createDataFrame([(1, "z", "x")], schema)
    with pytest.raises(PySparkException, match="before the open version"):
        scd2_merge(stored, late, KEYS, TRACKED, DAY_1, broadcast_batch=broadcast).collect()
    same = spark.createDataFrame([(1, "a", "x"), (3, "c", "x")], schema)  # closes nothing
    merged = scd2_merge(stored, same, KEYS, TRACKED, DAY_1, broadcast_batch=broadcast)
    assert sorted((r.c_custkey, r.effectiveDate) for r in merged.collect()) == [
        (1, DAY_2), (2, DAY_2), (3, DAY_1)
    ]


def test_a_batch_too_large_to_broadcast_is_shuffled(spark, plan, monkeypatch):
    import zonewright.operators.scd2 as scd2

    stored, batch = golden(spark, "sf0.001")
    monkeypatch.setattr(scd2, "fits_broadcast", lambda df: False)
    merged = scd2_merge(stored, batch, KEYS, TRACKED, DAY_2, broadcast_batch=True)
    assert "Broadcast" not in plan(merged)


def test_names_of_helper_columns_are_refused(spark):
    stored = scd2_open(spark.createDataFrame([(1, 2)], "k int, __side int"), DAY_1)
    with pytest.raises(ValueError, match="reserved"):
        scd2_merge(stored, stored.select("k", "__side"), ["k"], ["__side"], DAY_2)


def test_changes_under_null_keys(spark):
    schema = "c_custkey int, c_name string, c_mktsegment string"
    stored = scd2_open(spark.createDataFrame([(None, "a", "x"), (2, "b", None)], schema), DAY_1)
    batch = spark.createDataFrame([(None, "z", "x"), (2, "b", None), (3, "c", "x")], schema)
    assert [r.c_name for r in detect_changes(stored, batch, KEYS, TRACKED).collect()] == ["z"]


def states_as_of(rows, versions):
    out = []
    for i, key, day in rows:
        open_then = [v for k, v, a, b in versions if key is not None and day and k == key and a <= day and (b is None or day < b)]
        out.append((i, key, day, open_then[0] if open_then else None))
    return out


@pytest.mark.parametrize("share", [0.9, 0.02])
def test_lookup_as_of(spark, share):
    """Keys with many versions, a hot key, days on borders, and keys and days that are NULL."""
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    versions = []
    for key, step in ((1, 1), (2, 45), (3, 400), (None, 30)):
        begins = list(range(0, 900, step))
        for a, b in zip(begins, [*begins[1:], None], strict=True):
            versions.append((key, f"{key}@{a}", day(a), None if b is None else day(b)))
    versions.append((4, "closed", day(10), day(20)))
    versions.append((4, "same day", day(30), day(30)))
    history = spark.createDataFrame(
        [(k, v, a, b, b is None) for k, v, a, b in versions],
        "k int, v string, effectiveDate date, updateDate date, current boolean",
    )
    rows = [(i, 1 if i % 3 else i % 7, day(i % 950 - 20)) for i in range(3000)]
    rows += [(9001, None, day(5)), (9002, 1, None), (9003, 77, day(5)), (9004, 4, day(30)), (9005, 4, day(19)), (9006, 4, day(20))]
    df = spark.createDataFrame(rows, "id int, k int, at date").repartition(5)
    found = lookup_as_of(df, history, ["k"], "at", ["v"], share=share)
    assert found.columns == ["id", "k", "at", "v"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(states_as_of(rows, versions), key=str)
    assert lookup_as_of(df.limit(0), history, ["k"], "at", ["v"]).count() == 0
    assert lookup_as_of(df, history.limit(0), ["k"], "at", ["v"]).where("v is null").count() == len(rows)


def test_a_hot_key_is_spread_over_months(spark, plan):
    history = scd2_open(spark.createDataFrame([(1, "a")], "k int, v string"), "2020-01-01")
    rows = spark.range(40_000).selectExpr("1 k", "date_add(date'2020-01-01', int(id % 700)) at")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup_as_of(rows, history, ["k"], "at", ["v"], share=0.9)
        sizes = [n for _, n in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and len(sizes) == 4 and max(sizes) < 25_000
