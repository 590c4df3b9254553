"""The physical plans the operators are meant to get."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.dedupe import keep_latest
from sluiceway.operators.merge import (
    merge_into_files,
    merge_partition,
    merge_partitions,
    overwrite_partition,
    overwrite_where,
    upsert,
)
from sluiceway.operators.quality import check, report
from sluiceway.operators.rules import FilledRatio, MaxPercentile, ValueRatio
from sluiceway.sources.tables import CatalogTable, PathTable

SCHEMA = T.StructType()
for name in ("k", "v", "w", "ds"):
    SCHEMA.add(name, T.StringType())


def unique_exchanges(df):
    """Shuffles that run, once all stages are known: reused ones do not count."""
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", re.sub(r"ReusedExchange.*", "", final)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def landed(spark, folder):
    table = PathTable(folder, SCHEMA)
    data = spark.range(400).select(
        F.col("id").cast("string").alias("k"),
        F.lit("v").alias("v"),
        F.lit("w").alias("w"),
        F.when(F.col("id") % 2 == 0, "2024-01-01").otherwise("2024-01-02").alias("ds"),
    )
    table.replace_partition(data)
    return table


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_all_rules_share_one_scan_of_the_needed_columns(spark, landed):
    rules = [FilledRatio("v", 0.5), ValueRatio("v", "gt", 0, 0.5), FilledRatio("k", 0.5)]
    text = plan(report(landed.read(spark), rules))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1
    assert "ReadSchema: struct<k:string,v:string>" in text


def test_percentile_verdict_is_two_counters(spark):
    numbers = spark.range(1000).withColumn("x", F.col("id").cast("double"))
    text = plan(report(numbers, [MaxPercentile("x", 0.9, 5.0), FilledRatio("id", 0.5)]))
    assert "percentile" not in re.sub(r"max_percentile", "", text)
    assert "Exchange" not in text  # already measured, in two scans


def test_percentiles_take_two_scans(spark, landed):
    numbers = landed.read(spark).withColumn("x", F.col("k").cast("double"))
    start = latest_execution(spark)
    failed = check(numbers, [MaxPercentile("x", 0.9, 5.0), FilledRatio("k", 0.5)])
    assert [r.observed for r in failed] == [359.0, 1.0]
    assert scans(spark, start) == 2
    assert all(r.ok for r in check(numbers, [MaxPercentile("x", 0.9, 500.0)]))
    assert scans(spark, start) == 3


def test_dedupe_drops_copies_before_its_one_shuffle(spark, landed):
    text = plan(keep_latest(landed.read(spark), ["k"], ["v"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"WindowGroupLimit .*, Partial", text)) == 1
    assert len(re.findall(r"WindowGroupLimit .*, Final", text)) == 1


def executions(spark):
    """Ids of the executions that Spark still remembers, of which it forgets the oldest."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(i).executionId() for i in range(runs.size())]


def latest_execution(spark):
    return max(executions(spark), default=-1)


def scans(spark, start):
    """How many executions later than ``start`` have read files."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = 0
    for execution in executions(spark):
        if execution > start:
            nodes = store.planGraph(execution).allNodes()
            found += any("Scan parquet" in nodes.apply(j).name() for j in range(nodes.size()))
    return found


def test_merge_shuffles_each_side_once(spark, landed, no_broadcast):
    source = landed.read(spark).withColumn("v", F.lit("new"))
    merged = upsert(
        source, landed.read_partition(spark, "2024-01-01"), SCHEMA, ["k"], "ds", latest_by=["ds"]
    )
    assert unique_exchanges(merged) == 2
    text = plan(merged).split("== Initial Plan ==")[0]
    assert "Join" not in text and "Cartesian" not in text
    # One scan each; the source's copies go before its shuffle.
    assert text.count("FileScan") == 2
    assert re.search(r"WindowGroupLimit .* 1, Partial", text)


def test_small_shuffles_of_a_merge_are_coalesced(spark, landed, no_broadcast):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        source = landed.read(spark).withColumn("v", F.lit("new"))
        merged = upsert(source, landed.read_partition(spark, "2024-01-01"), SCHEMA, ["k"], "ds", latest_by=["ds"])
        assert unique_exchanges(merged) == 2
        assert plan(merged).split("== Initial Plan ==")[0].count("AQEShuffleRead coalesced") == 2
    finally:
        spark.conf.set(key, before)


def test_check_for_repeated_keys_adds_no_shuffle(spark, landed, no_broadcast):
    source, current = landed.read(spark), landed.read_partition(spark, "2024-01-01")
    merged = upsert(source, current, SCHEMA, ["k"], "ds")
    assert unique_exchanges(merged) == 2
    assert re.search(r"WindowGroupLimit .* 2, Partial", plan(merged))


def test_first_load_of_a_partition_has_no_join(spark, landed):
    assert landed.read_partition(spark, "2030-01-01") is None
    text = plan(upsert(landed.read(spark), None, SCHEMA, ["k"], "ds", latest_by=["ds"]))
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_rows_of_hot_keys_are_split_into_parts(spark, landed, no_broadcast):
    current = landed.read(spark).withColumn(
        "k", F.when(F.col("k").cast("int") % 3 == 0, "hot").otherwise(F.col("k"))
    )
    source = current.select("k", F.lit("new").alias("v"))
    merged = upsert(
        source, current, SCHEMA, ["k"], "ds", latest_by=["v"], hot_rows=50, small_rows=0
    )
    text = plan(merged)
    assert "FullOuter" not in text and "NestedLoop" not in text and "Cartesian" not in text
    assert re.search(r"Exchange hashpartitioning\(k#\d+, __null_0#\d+, __part#\d+L", text)
    # The current rows are shuffled once, beneath their union with the source.
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*__part", text.split("== Initial Plan ==")[-1])) == 1
    assert merged.count() == 400 and merged.filter("v = 'new'").count() == 400


@pytest.fixture
def bucketed(spark, folder):
    spark.sql(
        "CREATE TABLE in_buckets (k STRING, v STRING, w STRING, ds STRING) USING parquet"
        f" PARTITIONED BY (ds) CLUSTERED BY (k) SORTED BY (k) INTO 6 BUCKETS LOCATION '{folder}'"
    )
    yield CatalogTable("in_buckets")
    spark.sql("DROP TABLE in_buckets")


@pytest.mark.parametrize("keys", [["k"], ["w", "k"]])
def test_rows_in_buckets_are_merged_where_they_lie(spark, landed, bucketed, no_broadcast, keys):
    day = "2024-01-01"
    absent = F.when(F.col("k") != "4", F.col("k"))
    overwrite_partition(landed.read(spark).withColumn("k", absent), bucketed, day)
    source = landed.read(spark).withColumns({"k": absent, "v": F.lit("new"), "ds": F.lit(day)})
    current = bucketed.read_partition(spark, day)
    merged = upsert(
        source, current, SCHEMA, keys, "ds", latest_by=["v"], buckets=bucketed.buckets(spark)
    )
    merged.collect()
    text = plan(merged).split("== Initial Plan ==")[0]
    assert "Join" not in text and "Bucketed: true" in text
    below = text[text.index("Union") :]
    # Of the two sides of the union the source's comes first; the other has no exchange.
    scans = [line for line in below.splitlines() if "FileScan" in line or "Exchange" in line]
    assert "Bucketed: true" in scans[-1] and text[: text.index("Union")].count("Exchange") == 0
    assert sum("Exchange" in line for line in scans) == 2
    merge_partition(source, bucketed, keys, day, latest_by=["v"])
    got = {(r.k, r.v) for r in bucketed.read(spark).collect()}
    assert got == {(None if k == 4 else str(k), "new") for k in range(400)}
    assert bucketed.read(spark).count() == 400
    # What was written lies in buckets again, one file for each, and no table is left behind.
    files = bucketed.read(spark).select("_metadata.file_name").distinct().collect()
    assert len({re.search(r"_(\d{5})\.", r.file_name)[1] for r in files}) == len(files) == 6
    assert not [t.name for t in spark.catalog.listTables() if "_writing_" in t.name]


def test_buckets_by_other_columns_or_of_hot_keys_are_shuffled(spark, landed, bucketed, no_broadcast):
    day = "2024-01-01"
    overwrite_partition(landed.read(spark), bucketed, day)
    merge_partition(landed.read(spark).withColumn("v", F.lit("new")), bucketed, ["w"], day, latest_by=["k"])
    assert {r.v for r in bucketed.read(spark).collect()} == {"new"}
    source = bucketed.read(spark).withColumn("v", F.lit("newer"))
    merge_partition(source, bucketed, ["k"], day, latest_by=["w"], hot_rows=0, small_rows=0)
    assert [r.v for r in bucketed.read(spark).select("v").distinct().collect()] == ["newer"]
    assert bucketed.read(spark).count() == 200


def test_other_merges_keep_buckets(spark, landed, bucketed):
    bucketed.replace_partition(landed.read(spark))
    fresh = [("0", "new", "w", "2024-01-01"), ("1", "new", "w", "2024-01-02"), ("x", "new", "w", "2024-01-03")]
    source = spark.createDataFrame(fresh, SCHEMA)
    assert merge_partitions(source, bucketed, ["k"]) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert merge_into_files(spark.createDataFrame([("2", "newer", "w", "2024-01-01")], SCHEMA), bucketed, ["k"], "2024-01-01")
    assert overwrite_where(spark.createDataFrame([("y", "v", "w", "2024-01-02")], SCHEMA), bucketed, "k in ('3', 'y')")
    got = {r.k: r.v for r in bucketed.read(spark).collect()}
    want = {str(k): "v" for k in range(400) if k != 3} | {"0": "new", "1": "new", "x": "new", "2": "newer", "y": "v"}
    assert got == want and bucketed.read(spark).count() == len(want)
    # Buckets are pruned by key, which finds rows only in the files where the shuffle would put them.
    assert [bucketed.read(spark).filter(F.col("k") == k).count() for k in ("0", "2", "17", "x", "y", "3")] == [1, 1, 1, 1, 1, 0]


def test_empty_catalog_partition_has_no_join(spark, tmp_path):
    spark.sql(
        "CREATE TABLE unheld (k STRING, v STRING, w STRING, ds STRING) USING parquet"
        f" PARTITIONED BY (ds) LOCATION '{tmp_path}/unheld'"
    )
    try:
        current = CatalogTable("unheld").read_partition(spark, "2024-01-01")
        source = spark.createDataFrame([("a", "v", "w")], "k string, v string, w string")
        assert "Join" not in plan(upsert(source, current, SCHEMA, ["k"], "ds"))
    finally:
        spark.sql("DROP TABLE unheld")


def test_small_source_leaves_a_large_partition_unshuffled(spark, landed, no_broadcast):
    current = landed.read(spark)
    source = current.filter("k < '2'").select("k", F.lit("new").alias("v"))
    merged = upsert(source, current, SCHEMA, ["k"], "ds", latest_by=["v"], hot_rows=50)
    text = plan(merged)
    updated = text[: text.index("LeftAnti")]
    assert "BroadcastHashJoin" in updated and "RightOuter" in updated
    # The source's own, which reduces it to a row per key.
    assert updated.count("Exchange hashpartitioning") == 1
    # The second read of the partition takes the keys alone.
    assert "ReadSchema: struct<k:string>" in text
    assert merged.count() == 400 and merged.filter("v = 'new'").count() == source.count()


def test_reading_one_partition_lists_only_its_files(spark, landed):
    partition = landed.read_partition(spark, "2024-01-01")
    assert all("/ds=2024-01-01/" in f for f in partition.inputFiles())


def test_catalog_partition_is_pruned(spark, tmp_path):
    spark.sql(
        "CREATE TABLE pruned (k STRING, ds STRING) USING parquet PARTITIONED BY (ds)"
        f" LOCATION '{tmp_path}/pruned'"
    )
    try:
        text = plan(CatalogTable("pruned").read_partition(spark, "2024-01-01"))
        assert re.search(r"PartitionFilters: \[isnotnull\(ds.*\(ds#\d+ = 2024-01-01\)\]", text)
    finally:
        spark.sql("DROP TABLE pruned")
