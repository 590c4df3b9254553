import pytest

from sluiceway.operators.dedupe import keep_latest
from tests.conftest import rows


def test_latest_row_per_key_with_nulls_last(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w")],
        "k string, t int, v string",
    )
    assert rows(keep_latest(df, ["k"], ["t"])) == [("a", 3, "y"), ("b", None, "w")]


def test_rows_without_a_key_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    assert rows(keep_latest(df, ["k"], ["t"])) == [(None, 2), ("a", 1)]


def test_ties_fall_to_the_other_columns(spark):
    data = [("a", 1, "x", 5), ("a", 1, "y", 1), ("a", 1, "y", 2)]
    for order in (data, data[::-1], data[1:] + data[:1]):
        df = spark.createDataFrame(order, "k string, t int, v string, w int").repartition(3)
        assert rows(keep_latest(df, ["k"], ["t"])) == [("a", 1, "y", 2)]


def test_default_order_is_the_ingestion_time(spark):
    df = spark.sql(
        "select * from values ('a', timestamp'2024-01-01', 1), ('a', timestamp'2024-01-02', 0)"
        " as t(k, _ingest_ts, v)"
    )
    assert rows(keep_latest(df, ["k"]), "v") == [(0,)]


def test_composite_keys_and_unsortable_columns(spark):
    df = spark.sql(
        "select * from values (1, 'a', 1, map('x', 1)), (1, 'a', 2, map('x', 2)),"
        " (1, 'b', 1, map('x', 3)) as t(k1, k2, t, m)"
    )
    assert rows(keep_latest(df, ["k1", "k2"], ["t"]), "k1", "k2", "t") == [
        (1, "a", 2),
        (1, "b", 1),
    ]


def test_keys_that_are_equal_though_written_differently(spark):
    doubles = spark.sql(
        "select * from values (0.0D, 1), (-0.0D, 2), (double('NaN'), 3), (sqrt(-1.0D), 4)"
        " as t(k, t)"
    )
    assert sorted(r.t for r in keep_latest(doubles, ["k"], ["t"]).collect()) == [2, 4]
    texts = spark.sql(
        "select k collate utf8_lcase as k, t from values ('a', 1), ('A', 2), ('b', 3) as t(k, t)"
    )
    assert sorted(r.t for r in keep_latest(texts, ["K"], ["t"]).collect()) == [2, 3]


def test_keys_are_required(spark):
    with pytest.raises(ValueError, match="key"):
        keep_latest(spark.range(3), [], ["id"])
