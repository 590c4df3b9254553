"""Merges that rewrite single files, overwrites by predicate, and switches of location."""

import os
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.merge import (
    merge_into_files,
    merge_partition,
    merge_partitions,
    overwrite_partition,
    overwrite_where,
)
from sluiceway.sources.tables import CatalogTable, PathTable
from tests.conftest import rows
from tests.test_merge import brute_force

SCHEMA = T.StructType()
for name in ("k", "v", "w", "ds"):
    SCHEMA.add(name, T.StringType())
DDL = "k string, v string, w string, ds string"
DAY, OTHER = "2024-02-01", "2024-01-31"


@pytest.fixture(params=["path", "catalog"])
def table(request, spark, tmp_path):
    if request.param == "path":
        yield PathTable(str(tmp_path / "table"), SCHEMA)
        return
    spark.sql(f"CREATE TABLE by_file ({DDL}) USING parquet PARTITIONED BY (ds) LOCATION '{tmp_path}/table'")
    yield CatalogTable("by_file")
    spark.sql("DROP TABLE by_file")


@pytest.fixture
def catalog_table(spark, tmp_path):
    spark.sql(f"CREATE TABLE switched ({DDL}) USING parquet PARTITIONED BY (ds) LOCATION '{tmp_path}/table'")
    yield CatalogTable("switched")
    spark.sql("DROP TABLE switched")


def frame(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


def seed(spark, table, n=80, days=(DAY, OTHER), files=8):
    """Rows k0..kn, in files by tens of keys, one file of a range per day."""
    for day in days:
        part = spark.range(n).repartitionByRange(files, "id").select(
            F.concat(F.lit("k"), "id").alias("k"), F.lit("old").alias("v"), F.lit("w").alias("w"), F.lit(day).alias("ds")
        )
        table.swap_files([], part)


def held_files(tmp_path):
    return {str(f.relative_to(tmp_path)): f.read_bytes() for f in (tmp_path / "table").rglob("*.parquet")}


def test_files_without_a_key_of_the_source_stay_byte_for_byte(spark, table, tmp_path):
    seed(spark, table)
    before = held_files(tmp_path)
    assert len(before) == 16
    source = frame(spark, [("k3", "new", DAY), ("k5", "new", DAY), ("added", "new", DAY), ("k70", "new", OTHER)], "k string, v string, ds string")
    assert merge_into_files(source, table, ["k"], DAY) == 1
    after = held_files(tmp_path)
    kept = set(before) & set(after)
    assert len(kept) == 15 and all(before[f] == after[f] for f in kept)
    changed = [r for r in rows(table.read(spark)) if r[1] == "new"]
    assert changed == [("added", "new", None, DAY), ("k3", "new", "w", DAY), ("k5", "new", "w", DAY)]
    assert table.read(spark).count() == 161
    # Rows that are all new touch no file.
    assert merge_into_files(frame(spark, [("fresh", "new", "w", DAY)]), table, ["k"], DAY) == 0
    assert set(after) < set(held_files(tmp_path))


@pytest.mark.parametrize("seed_", range(3))
@pytest.mark.parametrize("small_rows", [0, 1000])
def test_file_merge_equals_brute_force(spark, folder, seed_, small_rows):
    draw = random.Random(seed_)
    schema = T.StructType()
    for name in ("k1", "k2", "v", "w", "ds"):
        schema.add(name, T.StringType())

    def key():
        return draw.choice([None, "", "a", "b"]), draw.choice([None, *"uvwxyz"])

    target = [(*key(), f"t{i}", f"w{i}") for i in range(60)]
    source = [(*k, f"s{i}") for k, i in {key(): i for i in range(8)}.items()]
    table = PathTable(folder, schema)
    wide = "k1 string, k2 string, v string, w string"
    table.replace_partition(spark.createDataFrame(target, wide).repartition(9).withColumn("ds", F.lit(DAY)))
    some = spark.createDataFrame(source, "k1 string, k2 string, v string")
    merge_into_files(some, table, ["k1", "k2"], DAY, stamp=True, small_rows=small_rows)
    want = [(*r, DAY) for r in brute_force(target, source)]
    assert rows(table.read(spark)) == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])


def test_first_file_merge_copies_and_odd_values(spark, table):
    value = "a/b c=%:{x}"
    source = frame(spark, [("a", "1", "x", value), ("a", "2", "x", value), (None, "3", "x", value)])
    merge_into_files(source, table, ["k"], value, latest_by=["v"])
    merge_into_files(frame(spark, [("a", "4", "y", value)]), table, ["k"], value)
    assert rows(table.read(spark)) == [(None, "3", "x", value), ("a", "4", "y", value)]
    merge_into_files(frame(spark, []), table, ["k"], value)
    assert table.read(spark).count() == 2
    with pytest.raises(Exception, match="more than once: a"):
        merge_into_files(source, table, ["k"], value)
    assert table.read(spark).count() == 2


def test_overwrite_where_spans_partitions_and_leaves_other_files(spark, table, tmp_path):
    seed(spark, table, days=(DAY, OTHER, "2024-03-01"))
    before = held_files(tmp_path)
    meets = "k in ('k3', 'k79') and ds < '2024-03-01'"
    fresh = frame(spark, [("k3", "fresh", None, DAY), ("k3", "again", None, DAY)])
    assert overwrite_where(fresh, table, meets) == 4
    after = held_files(tmp_path)
    kept = set(before) & set(after)
    assert len(kept) == 20 and all(before[f] == after[f] for f in kept)
    read = table.read(spark)
    assert read.count() == 3 * 80 - 4 + 2
    assert rows(read.filter("k = 'k3'")) == [
        ("k3", "again", None, DAY), ("k3", "fresh", None, DAY), ("k3", "old", "w", "2024-03-01")
    ]
    assert rows(read.filter("k = 'k79'"), "ds") == [("2024-03-01",)]


def test_overwrite_where_refuses_rows_outside_and_null_is_outside(spark, table, tmp_path):
    table.replace_partition(frame(spark, [("a", "1", "x", DAY), (None, "2", "x", DAY)]))
    before = held_files(tmp_path)
    for bad in (("b", "9", "x", DAY), (None, "9", "x", DAY)):
        with pytest.raises(Exception, match="does not meet"):
            overwrite_where(frame(spark, [("a", "9", "x", DAY), bad]), table, F.col("k") == "a")
    assert held_files(tmp_path) == before
    with pytest.raises(ValueError, match="missing"):
        overwrite_where(frame(spark, [("a", DAY)], "k string, ds string"), table, "k = 'a'")
    overwrite_where(frame(spark, []), table, "k = 'a'")  # a deletion
    assert rows(table.read(spark)) == [(None, "2", "x", DAY)]
    overwrite_where(frame(spark, [("n", "3", "x", OTHER)]), table, "k = 'n'")  # an insertion
    assert rows(table.read(spark)) == [(None, "2", "x", DAY), ("n", "3", "x", OTHER)]


def test_a_reader_sees_all_old_or_all_new_rows(spark, catalog_table, tmp_path):
    table = catalog_table
    table.replace_partition(frame(spark, [(f"k{i}", "old", "w", d) for i in range(20) for d in (DAY, OTHER)]))
    reader = table.read(spark).filter(F.col("ds") == DAY)
    files = [unquote(f.removeprefix("file://")) for f in reader.inputFiles()]
    merge_partition(frame(spark, [(f"k{i}", "new", "w", DAY) for i in range(10, 30)]), table, ["k"], DAY)
    assert all(os.path.exists(f) for f in files)  # who has listed them can read on
    assert sorted(r.v for r in table.read(spark).filter(F.col("ds") == DAY).collect()) == ["new"] * 20 + ["old"] * 10
    assert {r.v for r in table.read(spark).filter(F.col("ds") == OTHER).collect()} == {"old"}
    # In-place writes go on working in the new place.
    overwrite_partition(frame(spark, [("z", "last", "w", DAY)]), table, DAY)
    table.replace_partition(frame(spark, [("y", "dynamic", "w", OTHER)]))
    assert rows(table.read(spark)) == [("y", "dynamic", "w", OTHER), ("z", "last", "w", DAY)]


def test_a_run_that_dies_before_the_switch_changes_nothing(spark, catalog_table, tmp_path, monkeypatch):
    table = catalog_table
    table.replace_partition(frame(spark, [("a", "old", "w", DAY)]))
    boom = frame(spark, [("a", "new", "w", DAY)]).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        merge_partition(boom, table, ["k"], DAY)
    sql = type(spark).sql

    def killed(self, query, *args, **kwargs):
        if query.startswith("ALTER TABLE"):
            raise KeyboardInterrupt
        return sql(self, query, *args, **kwargs)

    with monkeypatch.context() as patched:
        patched.setattr(type(spark), "sql", killed)
        with pytest.raises(KeyboardInterrupt):
            merge_partition(frame(spark, [("a", "new", "w", DAY), ("b", "new", "w", DAY)]), table, ["k"], DAY)
    assert rows(table.read(spark)) == [("a", "old", "w", DAY)]
    left = {p.name for p in (tmp_path / "table" / "_versions").iterdir()}
    assert len(left) == 1  # that of the second, which had been written
    assert table.remove_unused(spark) == []  # too young
    assert {p.rsplit("/", 1)[1] for p in table.remove_unused(spark, older_than=-5)} == left
    assert rows(table.read(spark)) == [("a", "old", "w", DAY)]


@pytest.mark.parametrize("value", [DAY, "a/b c=%:{x}"])
def test_unused_versions_go_and_rows_stay(spark, catalog_table, tmp_path, value):
    table = catalog_table
    table.replace_partition(frame(spark, [("a", "0", "w", value), ("o", "0", "w", OTHER)]))
    for i in range(1, 4):
        merge_partition(frame(spark, [("a", str(i), "w", value)]), table, ["k"], value)
    merge_partition(frame(spark, []), table, ["k"], "2030-01-01")
    gone = table.remove_unused(spark, older_than=-5)
    assert len(gone) == 3  # the first place and two versions
    spark.catalog.refreshTable(table.name)
    assert rows(table.read(spark)) == [("a", "3", "w", value), ("o", "0", "w", OTHER)]
    assert len(list((tmp_path / "table" / "_versions").iterdir())) == 1
    assert table.remove_unused(spark, older_than=-5) == []


def test_a_backfill_lands_several_partitions_and_reads_only_these(spark, table, tmp_path):
    days = [f"2024-01-{d:02}" for d in range(1, 9)] + ["a/b c=%:{x}"]
    seed(spark, table, n=20, days=days, files=2)
    before = held_files(tmp_path)
    hit = [days[1], days[4], days[8], "2030-01-01"]
    source = frame(spark, [(f"k{i}", f"{d}-{i}", d) for d in hit for i in (3, 19, 50)], "k string, v string, ds string")
    read = table.read_partitions(spark, hit)
    assert len(read.inputFiles()) == 6
    assert merge_partitions(source, table, ["k"]) == sorted(hit)
    after = held_files(tmp_path)
    for f in before:
        if not any(unquote(f).startswith(f"table/ds={d}/") for d in hit):
            assert after[f] == before[f]
    got = table.read(spark)
    assert got.count() == 9 * 20 + 3 + 3
    for d in hit:
        held = d != "2030-01-01"
        assert rows(got.filter((F.col("ds") == d) & (F.col("v") != "old")), "k", "v", "w") == [
            ("k19", f"{d}-19", "w" if held else None), ("k3", f"{d}-3", "w" if held else None), ("k50", f"{d}-50", None)
        ]
    # A key of one partition says nothing about others, and copies need an order.
    twice = frame(spark, [("k1", "x", days[0]), ("k1", "y", days[1]), ("k1", "z", days[1])], "k string, v string, ds string")
    with pytest.raises(Exception, match="more than once"):
        merge_partitions(twice, table, ["k"])
    merge_partitions(twice, table, ["k"], latest_by=["v"])
    assert rows(table.read(spark).filter("k = 'k1' and v <> 'old'"), "v", "ds") == [("x", days[0]), ("z", days[1])]


def test_a_backfill_without_rows_or_with_rows_of_no_partition(spark, table):
    seed(spark, table, n=4, files=1)
    assert merge_partitions(frame(spark, []), table, ["k"]) == []
    for value in (None, ""):
        with pytest.raises(ValueError, match="partition needs a value"):
            merge_partitions(frame(spark, [("a", "1", "x", DAY), ("b", "1", "x", value)]), table, ["k"])
    assert table.read(spark).count() == 8


def test_a_backfill_shuffles_the_current_rows_once_before_they_are_written(spark, table, monkeypatch):
    seed(spark, table, n=40, files=2)
    plans = []
    monkeypatch.setattr(type(table), "switch_partitions", lambda _, df, values: plans.append(df))
    merge_partitions(frame(spark, [("k1", "x", "w", DAY), ("k1", "x", "w", OTHER)]), table, ["k"])
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 3  # source, current rows, and for the files
    assert text.count("FileScan") == 1 and "Join" not in text
