from datetime import date

import pytest
from pyspark.sql import functions as F

from sluiceway.context import RunContext
from sluiceway.functions.columns import event_date, field_of, is_filled, number_meets
from sluiceway.functions.text import double_text
from tests.conftest import rows

RUN_DATE = date(2024, 2, 1)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "text, expected",
    [
        ("34", RUN_DATE),
        ("", RUN_DATE),
        ("2024-02-30", RUN_DATE),
        ("06/01/2024", RUN_DATE),
        ("20240601", RUN_DATE),
        (None, RUN_DATE),
        ("2024-06-01", date(2024, 6, 1)),
        ("2024-06-01 12:00:00", date(2024, 6, 1)),
        ("2024-06-01T12:00:00Z", date(2024, 6, 1)),
        (" 2024-06-01 ", date(2024, 6, 1)),
        ("2024-06", date(2024, 6, 1)),
        ("2024", date(2024, 1, 1)),
    ],
)
def test_event_date_falls_back_to_the_run_date(spark, ansi, text, expected):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(event_date("t", "2024-02-01").alias("d")).first().d == expected
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize(
    "ddl, values, expected",
    [
        ("string", ["x", "", "   ", "\t", None], [True, False, False, True, False]),
        ("double", [1.0, 0.0, float("nan"), None], [True, True, False, False]),
        ("float", [1.0, float("nan"), None], [True, False, False]),
        ("bigint", [1, 0, None], [True, True, False]),
        ("date", [RUN_DATE, None], [True, False]),
    ],
)
def test_filled_depends_on_the_type(spark, ddl, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {ddl}")
    filled = df.select("i", is_filled(field_of(df, "c")).alias("f"))
    assert [row.f for row in filled.orderBy("i").collect()] == expected


@pytest.mark.parametrize(
    "op, expected",
    [
        ("gt", [True, False, False, False, False, False]),
        ("gte", [True, True, False, False, False, False]),
        ("lt", [False, False, True, False, False, False]),
        ("lte", [False, True, True, False, False, False]),
        ("eq", [False, True, False, False, False, False]),
        ("neq", [True, False, True, False, False, False]),
    ],
)
def test_comparison_counts_only_real_numbers(spark, op, expected):
    values = ["6", "5", "4", "NaN", None, "abc"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    met = df.select("i", number_meets(field_of(df, "c"), op, 5.0).alias("m"))
    assert [row.m for row in met.orderBy("i").collect()] == expected


def test_nan_bound_and_unknown_op(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "c double")
    met = number_meets(field_of(df, "c"), "eq", 1.0)
    assert df.select(F.sum(F.when(met, 1).otherwise(0)).alias("n")).first().n == 1
    with pytest.raises(ValueError, match="Unsupported op 'like'"):
        number_meets(field_of(df, "c"), "like", 1.0)


def test_field_is_found_by_exact_name_then_ignoring_case(spark):
    df = spark.createDataFrame([(1,)], "Amount int")
    assert field_of(df, "Amount").name == "Amount"
    assert field_of(df, "amount").name == "Amount"
    with pytest.raises(ValueError, match="matches 0"):
        field_of(df, "price")


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(" ",), ("x",)], "`a.b` string")
    assert rows(df.filter(is_filled(field_of(df, "a.b")))) == [("x",)]


@pytest.mark.parametrize(
    "value, text",
    [
        (0.98, "0.98"),
        (5000, "5000.0"),
        (0.0, "0.0"),
        (-1.5, "-1.5"),
        (1e-4, "1.0E-4"),
        (0.001, "0.001"),
        (12345678.9, "1.23456789E7"),
        (1e7, "1.0E7"),
        (9999999.0, "9999999.0"),
        (float("nan"), "NaN"),
        (float("-inf"), "-Infinity"),
        (None, "null"),
    ],
)
def test_doubles_are_written_as_on_the_jvm(spark, value, text):
    assert double_text(value) == text
    if value is not None:
        cast = F.lit(float(value)).cast("string").alias("t")
        assert spark.range(1).select(cast).first().t == text


def test_run_context_defaults_and_checks_the_date():
    context = RunContext.from_args("d", "g", "i", {})
    assert context.ds == date.today().isoformat()
    assert len(context.run_id) == 36
    given = RunContext.from_args("d", "g", "i", {"ds": "2024-02-29", "run_id": "r"})
    assert (given.ds, given.run_id) == ("2024-02-29", "r")
    for bad in ("2023-02-29", "20240201", "2024-2-1", "2024-02-01' OR '1'='1"):
        with pytest.raises(ValueError):
            RunContext.from_args("d", "g", "i", {"ds": bad})
