import pytest
from pyspark.sql import functions as F

from rulemesh.operators import joins
from rulemesh.operators.joins import HotKeys, fits_broadcast, key_profile, keyed_join, measured_bytes, stored


@pytest.fixture(scope="module")
def sides(spark):
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 40}", i) for i in range(80)] + [(None, 1)]
    large = spark.createDataFrame(rows, "key string, n int")
    keyed = spark.createDataFrame(
        [("hot", "a"), ("hot", "b")] + [(f"k{i}", "c") for i in range(30)], "key string, mark string"
    )
    return large, keyed


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_keeps_the_result(sides, how):
    large, keyed = sides
    expected = sorted(map(str, large.join(keyed, "key", how).collect()))
    for options in ({"hot_rows": 10}, {"hot_rows": 100}, {"fits": True}, {}):
        got = keyed_join(large, keyed, "key", how, **options)
        assert got.columns == large.join(keyed, "key", how).columns
        assert sorted(map(str, got.collect())) == expected


def test_hot_keys_get_tasks_by_size(sides):
    large, _ = sides
    assert key_profile(large, "key", 100) == HotKeys(381, (("hot", 4),))
    assert key_profile(large, "key", 10) == HotKeys(381, (("hot", 31),))
    assert key_profile(large, "key", 1000) == HotKeys(381)
    assert key_profile(large.limit(0), "key") == HotKeys(0)


def test_any_number_of_hot_keys(spark):
    large = spark.range(6000).selectExpr("CAST(id % 1500 AS STRING) AS key", "id AS n")
    profile = key_profile(large, "key", 3)
    assert len(profile.fanouts) == 1500 and {n for _, n in profile.fanouts} == {3}
    keyed = spark.range(0, 3000, 2).selectExpr("CAST(id AS STRING) AS key", "id AS mark")
    assert keyed_join(large, keyed, "key", hot_rows=3).count() == 3000


@pytest.mark.parametrize("how, count", [("left", 1000), ("left_anti", 955), ("inner", 45), ("left_semi", 45)])
def test_rows_without_a_key_are_spread(spark, how, count):
    large = spark.range(1000).selectExpr("CASE WHEN id >= 900 THEN id % 20 END AS key", "id AS n")
    keyed = spark.range(9).selectExpr("id AS key", "id AS mark").unionByName(
        spark.sql("SELECT CAST(NULL AS BIGINT) AS key, 7L AS mark")
    )
    assert key_profile(large, "key", 50) == HotKeys(1000, (), 19)
    joined = keyed_join(large, keyed, "key", how, hot_rows=50)
    assert joined.count() == count
    if how in ("left", "left_anti"):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            whole = keyed_join(large, keyed.hint("merge"), "key", how, hot_rows=50)
            parts = whole.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert parts < 600


def test_no_profile_where_all_rows_are_few(spark, sides, monkeypatch):
    large, keyed = sides
    monkeypatch.setattr(joins, "key_profile", None)
    assert keyed_join(large, keyed, "key", hot_rows=400, rows=381).count() > 0


def test_a_write_is_measured(spark):
    frame = spark.createDataFrame([("ab", 1), (None, 2)], "t string, n int")
    table, found = stored(frame, most=F.max("n"))
    assert sorted(map(str, table.collect())) == sorted(map(str, frame.collect()))
    assert found == {"rows": 2, "bytes": 2 * 32 + 2, "most": 2}
    table, found = stored(frame.filter("n > 5"), most=F.max("n"))
    assert table.count() == 0 and found == {"rows": 0, "bytes": 0, "most": 0}
    table, found = stored(frame.limit(0).join(frame.select("n"), "n"), "t")
    assert table.count() == 0 and found["rows"] == 0


def test_size_is_measured(spark):
    frame = spark.createDataFrame([("ab", 1), (None, 2)], "t string, n int")
    assert measured_bytes(frame) == 2 * 32 + 2
    assert fits_broadcast(frame) and not fits_broadcast(frame, 10)
    assert measured_bytes(frame.filter("n > 5")) == 0
