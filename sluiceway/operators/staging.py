"""Columns every landed row carries, and the single-partition filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import quoted


def with_ingestion_meta(df: DataFrame, run_id: str) -> DataFrame:
    """Add ``_ingest_ts`` (one instant per query) and ``_run_id``."""
    return df.withColumns({"_ingest_ts": F.current_timestamp(), "_run_id": F.lit(run_id)})


def stamp_partition(df: DataFrame, value: str, column: str = "ds") -> DataFrame:
    """File every row under one partition, replacing any value the column had."""
    return df.withColumn(column, F.lit(value))


def only_partition(df: DataFrame, value: str, column: str = "ds") -> DataFrame:
    """Keep the rows of one partition; on a partitioned table this prunes the scan."""
    return df.filter(quoted(column) == F.lit(value))
