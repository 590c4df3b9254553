from pyspark.sql import functions as F

from sluiceway.operators import sizes, skew
from tests.conftest import rows


def hot_keys(df, keys, **limits):
    return skew.hot_keys(df, keys, df.count(), **limits)


def crowded(spark):
    """Keys 0..199 once each, the null key 300 times and ('h', 1) 500 times."""
    ordinary = spark.range(200).select(F.col("id").cast("string").alias("a"), F.lit(0).alias("b"))
    null = spark.range(300).select(F.lit(None).cast("string").alias("a"), F.lit(0).alias("b"))
    hot = spark.range(500).select(F.lit("h").alias("a"), F.lit(1).alias("b"))
    return ordinary.union(null).union(hot)


def test_finds_exactly_the_keys_above_the_limit(spark):
    df = crowded(spark)
    assert rows(hot_keys(df, ["a", "b"], hot_rows=100)) == [(None, 0, 3), ("h", 1, 5)]
    assert rows(hot_keys(df, ["a", "b"], hot_rows=300)) == [("h", 1, 2)]
    assert hot_keys(df, ["a", "b"], hot_rows=500) is None


def test_nothing_is_hot_in_a_small_or_even_frame(spark):
    assert hot_keys(crowded(spark), ["a", "b"]) is None
    assert hot_keys(spark.range(1000), ["id"], hot_rows=10) is None
    assert hot_keys(spark.range(0), ["id"], hot_rows=0) is None


def test_a_bucket_heavy_with_ordinary_keys_is_not_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "_BUCKETS", 1)
    assert hot_keys(spark.range(1000), ["id"], hot_rows=10) is None
    assert rows(hot_keys(crowded(spark), ["a"], hot_rows=400)) == [("h", 2)]


def test_the_limit_does_not_grow_with_the_frame(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") / 4).cast("int").alias("k"))
    assert hot_keys(df, ["k"], hot_rows=4) is None
    assert hot_keys(df, ["k"], hot_rows=3).count() == 5000
    # So many keys are not marked for a broadcast.
    assert "broadcast" in hot_keys(df, ["k"], hot_rows=3)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(sizes, "SMALL_BYTES", 1000)
    assert "strategy=broadcast" not in hot_keys(df, ["k"], hot_rows=3)._jdf.queryExecution().logical().toString().split("Join")[0]
