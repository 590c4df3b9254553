"""The given tables in the shape of the jobs' sources, and where checks write."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.plans.metadata import ItemDef, export_items
from sluiceway.workspace import fresh_path

DS = "2024-02-01"


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def web_source(events: DataFrame) -> DataFrame:
    return events.select(
        text("event_id").alias("event_id"),
        text("user_id").alias("user_id"),
        text("ts").alias("ts"),
        "event_type",
        "props",
    )


def pos_source(orders: DataFrame) -> DataFrame:
    return orders.select(
        text("o_orderkey").alias("transaction_id"),
        text("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("store_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("currency"),
        text("o_orderdate").alias("timestamp"),
    )


def crm_source(customer: DataFrame) -> DataFrame:
    """One market segment has no date and one has text that is not a date."""
    created = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("01/15/2024"))
        .otherwise(F.lit("2024-01-15 08:30:00"))
    )
    return customer.select(
        text("c_custkey").alias("user_id"),
        F.col("c_name").alias("email"),
        text("c_nationkey").alias("country"),
        created.alias("created_at"),
    )


def spoiled_events(events: DataFrame) -> DataFrame:
    """Events with blanks, nulls and NaN, which the given table has none of."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        F.when(kind == "error", "  ").when(kind != "click", F.col("props")).alias("label"),
        F.when(kind == "error", F.lit(float("nan")))
        .when(kind != "view", F.col("value"))
        .alias("score"),
        F.when(kind != "signup", F.col("user_id")).alias("actor"),
    )


# The same in SQL.
SPOILED_EVENTS_SQL = """
    SELECT event_id, ts,
           CASE WHEN event_type = 'error' THEN '  '
                WHEN event_type <> 'click' THEN props END AS label,
           CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS score,
           CASE WHEN event_type <> 'signup' THEN user_id END AS actor
    FROM events
"""


def as_csv(df: DataFrame, name: str) -> str:
    """Write a frame as CSV files with a header to the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("header", "true").csv(path)
    return path


def database(spark: SparkSession, name: str) -> None:
    location = fresh_path(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")


def metadata_table(spark: SparkSession, items: Sequence[ItemDef] | None = None) -> str:
    """Export item definitions to a catalog table of their own and return its name."""
    database(spark, "meta")
    name = f"meta.item_defs_{uuid.uuid4().hex}"
    export_items(spark, items, table=name, path=fresh_path(spark, "item-defs"))
    return name


def partitioned_table(spark: SparkSession, ddl_columns: str, clause: str = "") -> str:
    """Create an empty catalog table partitioned by ``ds`` and return its name."""
    database(spark, "landing")
    name = f"landing.t_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({ddl_columns}, ds STRING) USING parquet PARTITIONED BY (ds)"
        f" {clause} LOCATION '{fresh_path(spark, 'landing')}'"
    )
    return name
