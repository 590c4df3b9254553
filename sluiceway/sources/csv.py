"""CSV files read with a declared schema, never an inferred one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import quoted


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    strict_header: bool = False,
    malformed: str | None = None,
) -> DataFrame:
    """Read a file, folder or glob of CSV files that start with a header row.

    Columns bind by position: surplus file columns are dropped, absent ones are null,
    and so is a number that does not parse. ``strict_header`` rejects files whose
    header differs from the schema instead.

    ``malformed`` names a further column, with the whole line of each row that has too few or too
    many columns or a value that does not parse, and null for others. The other columns are the
    same with and without.
    """
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    if strict_header:
        reader = reader.option("enforceSchema", "false")
    if malformed is None:
        return reader.schema(schema).csv(path)
    wider = T.StructType([*schema.fields, T.StructField(malformed, T.StringType())])
    rows = reader.option("columnNameOfCorruptRecord", malformed).option("columnPruning", "false").schema(wider).csv(path)
    # Spark parses, and so finds malformed, only columns that are used: the line uses none of each.
    line = quoted(malformed)
    used = F.substring(F.concat_ws("", *(quoted(name).cast("string") for name in schema.names)), 1, 0)
    return rows.withColumn(malformed, F.when(line.isNotNull(), F.concat(line, used)))
