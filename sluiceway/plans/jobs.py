"""The ingestion jobs: read, project, gate, keep the latest, upsert the run's partition."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluiceway.context import RunContext
from sluiceway.functions.columns import event_date
from sluiceway.operators.merge import merge_partition
from sluiceway.operators.quality import RuleResult, staged_gate
from sluiceway.operators.staging import with_ingestion_meta
from sluiceway.plans.metadata import METADATA_TABLE, load_item
from sluiceway.sources.csv import read_csv
from sluiceway.sources.tables import CatalogTable, PathTable, Table

logger = logging.getLogger(__name__)

Inputs = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Job:
    """What sets one item apart: its named inputs, its projection and its landed columns.

    ``read_sources`` turns arguments into named inputs. ``transform`` makes one frame of
    them, with an event date in the partition column. The rest is common to all jobs.
    """

    name: str
    domain: str
    group_name: str
    item_name: str
    read_sources: Callable[[SparkSession, Mapping[str, str]], Inputs]
    transform: Callable[[Inputs, RunContext], DataFrame]
    output_schema: T.StructType
    partition_column: str = "ds"

    def write(
        self,
        df: DataFrame,
        context: RunContext,
        table: Table | None = None,
        metadata_table: str = METADATA_TABLE,
    ) -> list[RuleResult]:
        """Check the rows against the item's rules, then merge them under the run date.

        The rows are computed once: they are staged while the rules are measured, and merged
        from there if all pass. Keys, rules and the output table come from metadata. ``table`` replaces the output
        table, for a session whose catalog does not hold it.
        """
        item = load_item(df.sparkSession, self.domain, self.item_name, metadata_table)
        with staged_gate(df, item.rules()) as (staged, results):
            merge_partition(
                with_ingestion_meta(staged, context.run_id),
                table or CatalogTable(item.output_table, self.partition_column),
                item.key_columns,
                context.ds,
                # One instant per run, so among copies in one run the latest event date wins.
                latest_by=("_ingest_ts", self.partition_column),
                stamp=True,
            )
        return results


def csv_input(
    item_name: str, schema: T.StructType
) -> Callable[[SparkSession, Mapping[str, str]], Inputs]:
    """One input, ``raw``, read from the CSV files that ``inputPath`` names."""

    def read(spark: SparkSession, args: Mapping[str, str]) -> Inputs:
        path = args.get("inputPath") or f"/mnt/data/{item_name}.csv"
        return {"raw": read_csv(spark, path, schema)}

    return read


# The columns of the three sources and of the tables they land in.

CRM_USERS_SOURCE = T.StructType(
    [
        T.StructField("user_id", T.StringType(), nullable=False),
        T.StructField("email", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)
POS_TRANSACTIONS_SOURCE = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), nullable=False),
        T.StructField("user_id", T.StringType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
WEB_EVENTS_SOURCE = T.StructType(
    [
        T.StructField("event_id", T.StringType(), nullable=False),
        T.StructField("user_id", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("props", T.StringType()),
    ]
)
CRM_USERS_LANDED = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("ds", T.StringType()),
        T.StructField("_ingest_ts", T.TimestampType()),
        T.StructField("_run_id", T.StringType()),
    ]
)
POS_TRANSACTIONS_LANDED = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("ds", T.StringType()),
        T.StructField("_ingest_ts", T.TimestampType()),
        T.StructField("_run_id", T.StringType()),
    ]
)
WEB_EVENTS_LANDED = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ds", T.StringType()),
        T.StructField("props", T.StringType()),
        T.StructField("_ingest_ts", T.TimestampType()),
        T.StructField("_run_id", T.StringType()),
    ]
)


def _crm_users(inputs: Inputs, context: RunContext) -> DataFrame:
    return (
        inputs["raw"]
        .withColumn("ds", event_date("created_at", context.ds))
        .select("user_id", "email", "country", "ds")
    )


def _pos_transactions(inputs: Inputs, context: RunContext) -> DataFrame:
    return inputs["raw"].select(
        "transaction_id",
        "user_id",
        "store_id",
        "amount",
        "currency",
        event_date("timestamp", context.ds).alias("ds"),
    )


def _web_events(inputs: Inputs, context: RunContext) -> DataFrame:
    return inputs["raw"].select(
        "event_id", "user_id", "event_type", event_date("ts", context.ds).alias("ds"), "props"
    )


CRM_USERS = Job(
    name="CRMUsersJob",
    domain="core",
    group_name="crm",
    item_name="crm_users",
    read_sources=csv_input("crm_users", CRM_USERS_SOURCE),
    transform=_crm_users,
    output_schema=CRM_USERS_LANDED,
)

POS_TRANSACTIONS = Job(
    name="POSTransactionsJob",
    domain="payments",
    group_name="pos",
    item_name="pos_transactions",
    read_sources=csv_input("pos_transactions", POS_TRANSACTIONS_SOURCE),
    transform=_pos_transactions,
    output_schema=POS_TRANSACTIONS_LANDED,
)

WEB_EVENTS = Job(
    name="WebEventsJob",
    domain="analytics",
    group_name="web",
    item_name="web_events",
    read_sources=csv_input("web_events", WEB_EVENTS_SOURCE),
    transform=_web_events,
    output_schema=WEB_EVENTS_LANDED,
)

JOBS = {job.item_name: job for job in (CRM_USERS, POS_TRANSACTIONS, WEB_EVENTS)}


def run_job(
    spark: SparkSession,
    job: Job,
    args: Mapping[str, str] | None = None,
    metadata_table: str = METADATA_TABLE,
) -> list[RuleResult]:
    """Run one job end to end and return the outcome of its rules.

    ``args``: ``inputPath`` (default ``/mnt/data/<item>.csv``), ``ds`` (default today),
    ``run_id`` (default a new UUID), and ``outputTable`` or ``outputPath`` to land in
    another catalog table, or under a path, instead of the table named in metadata.
    """
    args = args or {}
    context = RunContext.from_args(job.domain, job.group_name, job.item_name, args)
    table = None
    if args.get("outputPath"):
        table = PathTable(args["outputPath"], job.output_schema, job.partition_column)
    elif args.get("outputTable"):
        table = CatalogTable(args["outputTable"], job.partition_column)
    logger.info("Starting %s run_id=%s ds=%s", job.name, context.run_id, context.ds)
    transformed = job.transform(job.read_sources(spark, args), context)
    results = job.write(transformed, context, table, metadata_table)
    logger.info("Completed %s run_id=%s", job.name, context.run_id)
    return results
