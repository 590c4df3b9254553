import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators import merge, sizes
from sluiceway.operators.merge import merge_partition, overwrite_partition, upsert
from sluiceway.sources.tables import CatalogTable, PathTable
from tests.conftest import rows

SCHEMA = T.StructType()
for name in ("k", "v", "note", "ds"):
    SCHEMA.add(name, T.StringType())

DAY, OTHER = "2024-02-01", "2024-01-31"


@pytest.fixture(params=["path", "catalog"])
def table(request, spark, tmp_path):
    location = str(tmp_path / "table")
    if request.param == "path":
        yield PathTable(location, SCHEMA)
        return
    spark.sql(
        "CREATE TABLE merge_target (k STRING, v STRING, note STRING, ds STRING)"
        f" USING parquet PARTITIONED BY (ds) LOCATION '{location}'"
    )
    yield CatalogTable("merge_target")
    spark.sql("DROP TABLE merge_target")


def frame(spark, data, ddl="k string, v string, note string, ds string"):
    return spark.createDataFrame(data, ddl)


def files(tmp_path, day):
    found = sorted((tmp_path / "table" / f"ds={day}").glob("*.parquet"))
    return {f.name: f.read_bytes() for f in found}


def test_overwrite_replaces_one_partition_only(spark, table, tmp_path):
    table.replace_partition(frame(spark, [("a", "1", "n", DAY), ("b", "2", "n", OTHER)]))
    before = files(tmp_path, OTHER)
    # Columns in another order, and a row of a partition that is not replaced.
    fresh = spark.createDataFrame(
        [(DAY, "n", "9", "c"), (OTHER, "n", "0", "dropped")],
        "ds string, note string, v string, k string",
    )
    overwrite_partition(fresh, table, DAY)
    assert rows(table.read(spark)) == [("b", "2", "n", OTHER), ("c", "9", "n", DAY)]
    assert files(tmp_path, OTHER) == before


def test_overwrite_from_the_partition_itself(spark, table):
    table.replace_partition(frame(spark, [("a", "1", "n", DAY), ("b", "2", "n", OTHER)]))
    overwrite_partition(table.read(spark).withColumn("v", F.lit("new")), table, DAY)
    assert rows(table.read(spark)) == [("a", "new", "n", DAY), ("b", "2", "n", OTHER)]


def test_overwrite_with_nothing_leaves_the_partition(spark, table):
    table.replace_partition(frame(spark, [("a", "1", "n", DAY)]))
    overwrite_partition(frame(spark, []), table, DAY)
    assert rows(table.read(spark)) == [("a", "1", "n", DAY)]


def test_overwrite_needs_the_columns_of_the_table(spark, table):
    with pytest.raises(ValueError, match="missing.*note"):
        overwrite_partition(frame(spark, [("a", DAY)], "k string, ds string"), table, DAY)
    extra = frame(spark, [("a", "1", "n", DAY)]).withColumn("extra", F.lit(1))
    with pytest.raises(ValueError, match="extra"):
        overwrite_partition(extra, table, DAY)


def test_overwrite_mode_of_the_session_is_restored(spark, table):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    overwrite_partition(frame(spark, [("a", "1", "n", DAY)]), table, DAY)
    with pytest.raises(Exception):
        boom = F.raise_error(F.lit("boom")).cast("string")
        overwrite_partition(
            frame(spark, [("a", "1", "n", DAY)]).withColumn("v", boom), table, DAY
        )
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert rows(table.read(spark)) == [("a", "1", "n", DAY)]


def test_partition_values_with_special_characters(spark, table):
    value = "a/b c=%:{x}"
    table.replace_partition(frame(spark, [("a", "1", "n", value), ("b", "2", "n", OTHER)]))
    merge_partition(frame(spark, [("a", "9", "m", value)]), table, ["k"], value)
    assert rows(table.read(spark)) == [("a", "9", "m", value), ("b", "2", "n", OTHER)]
    merge_partition(frame(spark, [("c", "1", "m", value)]), table, ["k"], value)
    assert rows(table.read(spark)) == [("a", "9", "m", value), ("b", "2", "n", OTHER), ("c", "1", "m", value)]


def test_merge_updates_inserts_and_keeps(spark, table, tmp_path):
    table.replace_partition(
        frame(
            spark,
            [
                ("match", "old", "kept", DAY),
                ("target only", "old", "kept", DAY),
                (None, "old", "kept", DAY),
                ("match", "other day", "kept", OTHER),
            ],
        )
    )
    before = files(tmp_path, OTHER)
    source = frame(
        spark,
        [
            ("match", "new", DAY),
            ("source only", "new", DAY),
            (None, "new", DAY),
            ("wrong day", "new", OTHER),
        ],
        "k string, v string, ds string",
    )
    expected = [
        (None, "new", "kept", DAY),
        ("match", "new", "kept", DAY),
        ("match", "other day", "kept", OTHER),
        ("source only", "new", None, DAY),
        ("target only", "old", "kept", DAY),
    ]
    merge_partition(source, table, ["k"], DAY)
    assert rows(table.read(spark)) == expected
    assert files(tmp_path, OTHER) == before
    merge_partition(source, table, ["k"], DAY)
    assert rows(table.read(spark)) == expected


def test_merge_sets_nulls_from_the_source(spark, table):
    table.replace_partition(frame(spark, [("a", "1", "n", DAY)]))
    merge_partition(frame(spark, [("a", None, None, DAY)]), table, ["k"], DAY)
    assert rows(table.read(spark)) == [("a", None, None, DAY)]


def test_every_copy_of_a_repeated_target_key_is_updated(spark, table):
    table.replace_partition(
        frame(spark, [("a", "1", "x", DAY), ("a", "2", "y", DAY), ("b", "3", "z", DAY)])
    )
    source = frame(spark, [("a", "new", DAY)], "k string, v string, ds string")
    merge_partition(source, table, ["k"], DAY)
    assert rows(table.read(spark)) == [
        ("a", "new", "x", DAY),
        ("a", "new", "y", DAY),
        ("b", "3", "z", DAY),
    ]


def test_merge_of_keys_alone_changes_nothing_that_matches(spark, table):
    table.replace_partition(frame(spark, [("a", "1", "x", DAY)]))
    merge_partition(
        frame(spark, [("a", DAY), ("b", DAY)], "k string, ds string"), table, ["k"], DAY
    )
    assert rows(table.read(spark)) == [("a", "1", "x", DAY), ("b", None, None, DAY)]


def test_repeated_source_key_is_refused_unless_reduced(spark, table):
    source = frame(spark, [("a", "1", "x", DAY), ("a", "2", "x", DAY)])
    nulls = frame(spark, [("b", "1", "x", DAY), (None, "1", "x", DAY), (None, "1", "x", DAY)])
    held = frame(spark, [("a", "0", "x", DAY), ("c", "0", "x", DAY)])
    for attempt in ("first load", "merge"):
        with pytest.raises(Exception, match="more than once: a"):
            merge_partition(source, table, ["k"], DAY)
        with pytest.raises(Exception, match="more than once: null"):
            merge_partition(nulls, table, ["k"], DAY)
        with pytest.raises(Exception, match="more than once: a"):
            merge_partition(source, table, ["k"], DAY, hot_rows=0)
        if attempt == "first load":
            table.replace_partition(held)
    assert rows(table.read(spark)) == [("a", "0", "x", DAY), ("c", "0", "x", DAY)]
    overwrite_partition(held.filter("k = 'a'"), table, DAY)
    merge_partition(source, table, ["k"], DAY, latest_by=["v"])
    assert rows(table.read(spark)) == [("a", "2", "x", DAY)]


def test_stamp_files_every_row_under_the_value(spark, table):
    source = frame(
        spark,
        [("a", "1", "x", "2024-03-01"), ("a", "0", "x", "2024-04-01"), ("b", "2", "x", OTHER)],
    )
    merge_partition(source, table, ["k"], DAY, latest_by=["ds"], stamp=True)
    assert rows(table.read(spark)) == [("a", "0", "x", DAY), ("b", "2", "x", DAY)]


def test_merge_without_keys_or_with_unknown_columns(spark, table):
    with pytest.raises(ValueError, match="key"):
        merge_partition(frame(spark, [("a", "1", "x", DAY)]), table, [], DAY)
    extra = frame(spark, [("a", "1", "x", DAY)]).withColumn("extra", F.lit(1))
    with pytest.raises(ValueError, match="extra"):
        merge_partition(extra, table, ["k"], DAY)


def test_names_match_whatever_their_case(spark, table):
    table.replace_partition(frame(spark, [("a", "1", "x", DAY)]))
    source = frame(spark, [("a", "2", DAY)], "K string, V string, DS string")
    merge_partition(source, table, ["K"], DAY)
    assert rows(table.read(spark)) == [("a", "2", "x", DAY)]
    with pytest.raises(ValueError, match="id"):
        merge_partition(source, table, ["id"], DAY)


def test_partition_column_among_the_keys_adds_nothing(spark, table):
    table.replace_partition(frame(spark, [("a", "1", "x", DAY)]))
    source = frame(spark, [("a", "2", DAY)], "k string, v string, ds string")
    merge_partition(source, table, ["k", "ds", "k"], DAY)
    assert rows(table.read(spark)) == [("a", "2", "x", DAY)]
    with pytest.raises(ValueError, match="besides the partition"):
        merge_partition(source, table, ["ds"], DAY)


def test_date_partition_column_and_dotted_names(spark, tmp_path):
    spark.sql(
        "CREATE TABLE dated (`k.x` BIGINT, v STRING, ds DATE) USING parquet"
        f" PARTITIONED BY (ds) LOCATION '{tmp_path}/dated'"
    )
    try:
        table = CatalogTable("dated")
        source = spark.sql(f"select 1 as `k.x`, 'a' as v, date'{DAY}' as ds")
        merge_partition(source, table, ["k.x"], DAY)
        merge_partition(source.withColumn("v", F.lit("b")), table, ["k.x"], DAY)
        overwrite_partition(table.read(spark), table, DAY)
        assert rows(table.read(spark).withColumn("ds", F.col("ds").cast("string"))) == [
            (1, "b", DAY)
        ]
    finally:
        spark.sql("DROP TABLE dated")


def test_empty_source_and_empty_target(spark, table):
    merge_partition(frame(spark, []), table, ["k"], DAY)
    assert rows(table.read(spark)) == []
    merge_partition(frame(spark, [("a", "1", "x", DAY)]), table, ["k"], DAY)
    merge_partition(frame(spark, []), table, ["k"], DAY)
    assert rows(table.read(spark)) == [("a", "1", "x", DAY)]


def test_missing_catalog_table_is_an_error(spark):
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        merge_partition(frame(spark, [("a", "1", "x", DAY)]), CatalogTable("nowhere"), ["k"], DAY)


@pytest.mark.parametrize(
    "ddl, a, b",
    [
        ("bigint", 0, 5),
        ("double", 0.0, float("nan")),
        ("decimal(10,2)", 0, 3),
        ("boolean", False, True),
        ("string", "", " "),
    ],
)
def test_null_key_is_not_confused_with_a_zero(spark, ddl, a, b):
    schema = T.StructType(
        [
            T.StructField("k", spark.sql(f"select cast(null as {ddl}) k").schema["k"].dataType),
            T.StructField("v", T.StringType()),
            T.StructField("ds", T.StringType()),
        ]
    )

    def keyed(values, v):
        data = [(str(k) if k is not None else None, v) for k in values]
        return spark.createDataFrame(data, "k string, v string").select(
            F.col("k").cast(ddl).alias("k"), "v"
        )

    merged = upsert(
        keyed([None, b], "new"), keyed([None, a], "old"), schema, ["k"], "ds"
    ).select(F.col("k").cast("string").alias("k"), "v")
    text = keyed([a, b], "").select(F.col("k").cast("string")).collect()
    assert rows(merged) == sorted(
        [(None, "new"), (text[0].k, "old"), (text[1].k, "new")],
        key=lambda r: (r[0] is not None, str(r[0])),
    )


def brute_force(target, source):
    """Rows (k1, k2, v, w) merged on (k1, k2); the source has no w."""
    new = {(k1, k2): v for k1, k2, v in source}
    held = {(k1, k2) for k1, k2, _, _ in target}
    merged = [(k1, k2, new.get((k1, k2), v), w) for k1, k2, v, w in target]
    return merged + [(*key, v, None) for key, v in new.items() if key not in held]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(
    "hot_rows, small_rows", [(5, 0), (5, 1000), (1_000_000, 0)], ids=["hot", "small", "plain"]
)
def test_merge_equals_brute_force(spark, seed, hot_rows, small_rows):
    draw = random.Random(seed)
    schema = T.StructType()
    for name in ("k1", "k2", "v", "w", "ds"):
        schema.add(name, T.StringType())

    def key():
        # A third of all rows share one key.
        if draw.random() < 0.34:
            return None, "hot"
        return draw.choice([None, "", "a", "b"]), draw.choice([None, *"uvwxyz"])

    target = [(*key(), f"t{i}", f"w{i}") for i in range(120)]
    source = list({key(): i for i in range(40)}.items())
    source = [(*k, f"s{i}") for k, i in source]
    merged = upsert(
        spark.createDataFrame(source, "k1 string, k2 string, v string").repartition(2),
        spark.createDataFrame(target, "k1 string, k2 string, v string, w string"),
        schema,
        ["k1", "k2"],
        "ds",
        hot_rows=hot_rows,
        small_rows=small_rows,
    )
    expected = sorted(
        brute_force(target, source), key=lambda row: [(v is not None, str(v)) for v in row]
    )
    assert rows(merged) == expected


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sizes, "SMALL_BYTES", 100)
    monkeypatch.setattr(merge, "hot_keys", lambda *_: None)
    current = spark.range(50).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"))
    source = current.filter("k < '2'").withColumn("v", F.lit("new" * 50))
    schema = T.StructType().add("k", "string").add("v", "string").add("ds", "string")
    merged = upsert(source, current, schema, ["k"], "ds", hot_rows=5, small_rows=1000)
    assert "strategy=broadcast" not in merged._jdf.queryExecution().logical().toString()
    assert merged.count() == 50
    assert merged.filter(F.length("v") > 100).count() == source.count()


def test_sparse_wide_rows_are_measured_as_rows_not_as_text(spark):
    nulls = {f"c{i}": F.lit(None).cast("double") for i in range(300)}
    wide = spark.range(100_000).select(F.lit("k").alias("k")).withColumns(nulls)
    n, held = sizes.measured(wide)
    assert n == 100_000 and held > 200 << 20
    assert not sizes.is_small(wide)
    nested = spark.sql("select array('ab', null) a, map(1, 'x') m, named_struct('s', 'yz') s, null n")
    assert 100 < sizes.measured(nested)[1] < 400
    assert sizes.measured(spark.range(0)) == (0, 0)


@pytest.mark.parametrize("value", ["", None])
def test_an_empty_partition_value_is_refused(spark, table, value):
    with pytest.raises(ValueError, match="partition needs a value"):
        merge_partition(frame(spark, [("a", "1", "n", "")]), table, ["k"], value, stamp=True)
    with pytest.raises(ValueError, match="partition needs a value"):
        overwrite_partition(frame(spark, [("a", "1", "n", "")]), table, value)


def test_columns_that_only_the_files_have_are_not_lost(spark, folder):
    wider = T.StructType([*SCHEMA.fields[:-1], T.StructField("extra", T.StringType()), SCHEMA["ds"]])
    PathTable(folder, wider).replace_partition(
        frame(spark, [("a", "1", "n", "x", DAY)], "k string, v string, note string, extra string, ds string")
    )
    with pytest.raises(ValueError, match="extra"):
        merge_partition(frame(spark, [("b", "1", "n", DAY)]), PathTable(folder, SCHEMA), ["k"], DAY)
    assert PathTable(folder, wider).read(spark).count() == 1


def test_helper_names_are_refused(spark):
    schema = T.StructType().add("k", "string").add("__part", "string").add("ds", "string")
    source = spark.createDataFrame([("a", "b")], "k string, __part string")
    with pytest.raises(ValueError, match="__part"):
        upsert(source, None, schema, ["k"], "ds")


@pytest.mark.parametrize(
    "ddl, texts",
    [
        ("struct<a: int, b: string>", ["named_struct('a', 1, 'b', 'x')", "named_struct('a', null, 'b', 'x')", "named_struct('a', 0, 'b', '')", "null"]),
        ("array<int>", ["array(1, 2)", "array(1, null)", "array()", "null"]),
        ("array<struct<a: double>>", ["array(named_struct('a', 1.5D))", "array(null)", "array()", "null"]),
        ("interval day to second", ["interval '1' day", "interval '0' second", "null"]),
        ("interval year to month", ["interval '1' year", "interval '0' month", "null"]),
        ("binary", ["x'00'", "x''", "null"]),
    ],
)
@pytest.mark.parametrize("way", [{}, {"hot_rows": 1, "small_rows": 0}, {"hot_rows": 1}], ids=["plain", "hot", "few"])
def test_nested_and_interval_keys(spark, ddl, texts, way):
    """Every key is held twice but the last but one, which is new."""
    schema = T.StructType([T.StructField("k", spark.sql(f"select cast(null as {ddl}) k").schema["k"].dataType), T.StructField("v", T.StringType()), T.StructField("ds", T.StringType())])

    def keyed(some, v):
        return spark.sql(" union all ".join(f"select cast({t} as {ddl}) k, '{v}' v" for t in some))

    held = [t for i, t in enumerate(texts) if i != len(texts) - 2]
    merged = upsert(keyed(texts, "new"), keyed(held + held, "old"), schema, ["k"], "ds", **way)
    assert dict(merged.dtypes)["k"] == schema["k"].dataType.simpleString()
    got = sorted((str(r.k), r.v) for r in merged.select(F.to_json(F.struct("k")).alias("k"), "v").collect()) if ddl != "binary" else sorted((str(r.k), r.v) for r in merged.collect())
    assert len(got) == 2 * len(held) + 1 and {v for _, v in got} == {"new"}
    assert len({k for k, _ in got}) == len(texts)


def test_a_map_is_no_key(spark):
    source = spark.sql("select map(1, 2) k, 'v' v")
    with pytest.raises(TypeError, match="map<int,int>"):
        upsert(source, source, T.StructType([*source.schema, T.StructField("ds", T.StringType())]), ["k"], "ds")
