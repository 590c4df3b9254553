"""Percentile rules over a whole landed table, from profiles kept for each of its partitions.

A profile holds, for a numeric column of a partition, how many numbers there are, their extent
and a KLL sketch. Sketches merge, so a rule over all partitions reads profiles and no rows, and
a run that lands one partition has only that one profiled again. Which ones that are is told by
the names of the files, which are never written twice.

A rule needs to know how many numbers are at most its maximum. Partitions that lie wholly on one
side of it say so exactly. For the rest the sketch gives the share to within ``margin``;
if the verdict may still be either, the rows of these partitions alone are counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import field_of, quoted
from sluiceway.operators.quantile import is_number, settled_quantiles
from sluiceway.operators.rules import MaxPercentile
from sluiceway.sources.tables import FILE, PathTable, Table

#: Numbers a sketch keeps for each of its levels; some 80 KB in all.
ACCURACY = 4096
_ERRORS = 4


@dataclass(frozen=True)
class LandedResult:
    """A verdict; ``low`` and ``high`` bracket the quantile and are None if there are no numbers."""

    rule: MaxPercentile
    ok: bool
    numbers: int
    low: float | None
    high: float | None
    counted: int  # partitions of which the rows were counted


def margin(accuracy: int = ACCURACY) -> float:
    """Four times the error that a sketch's ranks keep to with 99 per cent; the odds beyond are under 1e-20."""
    return _ERRORS * 2.296 / accuracy**0.9723  # fixed values: the published fit of the error


def profile_table(path: str, table: Table) -> PathTable:
    """Where the profiles of a table are kept: as Parquet, by partition as the table itself."""
    schema = T.StructType()
    for name, kind in (
        ("column", T.StringType()),
        ("numbers", T.LongType()),
        ("lo", T.DoubleType()),
        ("hi", T.DoubleType()),
        ("sketch", T.BinaryType()),
        ("files", T.LongType()),
        ("names", T.LongType()),
        ("accuracy", T.IntegerType()),
        (table.partition_column, T.StringType()),
    ):
        schema.add(name, kind)
    return PathTable(path, schema, table.partition_column)


def refresh_profiles(
    spark: SparkSession, table: Table, profiles: PathTable, columns: Sequence[str], accuracy: int = ACCURACY
) -> list[str | None]:
    """Profile the partitions whose files are not those that were profiled, in one pass over them alone.

    Also those of which a column is not there, or was profiled with another accuracy; gives their values, null for
    rows without one. The driver holds the values of partitions.
    """
    by = table.partition_column
    fields = [field_of(table.read(spark), c) for c in dict.fromkeys(columns)]
    odd = [f.name for f in fields if not isinstance(f.dataType, T.NumericType)]
    if odd:
        raise TypeError(f"only numeric columns are profiled, not {odd}")
    now = _files_by_partition(spark, table)
    known = _current(spark, table, profiles, now).filter(F.col("accuracy") == accuracy)
    wanted = now.select(quoted(by), "files", "names").withColumn(
        "column", F.explode(F.array(*(F.lit(f.name) for f in fields)))
    )
    same = _same(wanted, known, by) & (wanted["column"] == known["column"])
    stale = [r[0] for r in wanted.join(known, same, "left_anti").select(quoted(by)).distinct().collect()]
    if not stale:
        return []
    some = _of(table.read(spark), by, stale)
    held = some.groupBy(quoted(by)).agg(
        *(_profile(f.name, accuracy).alias(f"{i}") for i, f in enumerate(fields))
    )
    each = held.select(quoted(by), F.inline(F.array(*(F.col(f"`{i}`") for i in range(len(fields))))))
    named = now.select(quoted(by).alias("__of"), "files", "names")
    rows = each.join(named, quoted(by).eqNullSafe(F.col("__of"))).drop("__of")
    profiles.replace_partition(rows.withColumn("accuracy", F.lit(accuracy)))
    return sorted(stale, key=lambda v: (v is not None, v))


def _profile(column: str, accuracy: int) -> Column:
    value = quoted(column).cast("double")
    number = F.when(is_number(value), value)
    return F.struct(
        F.lit(column).alias("column"),
        F.count(number).alias("numbers"),
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
        F.kll_sketch_agg_double(number, accuracy).alias("sketch"),
    )


def _files_by_partition(spark: SparkSession, table: Table) -> DataFrame:
    """Per partition, how many files it has and a hash of their names; reads no column of theirs."""
    by = table.partition_column
    names = table.read_with_files(spark).select(quoted(by).cast("string").alias(by), FILE).distinct()
    return names.groupBy(quoted(by)).agg(
        F.count("*").alias("files"), F.bit_xor(F.xxhash64(FILE)).alias("names")
    )


def _current(spark: SparkSession, table: Table, profiles: PathTable, now: DataFrame) -> DataFrame:
    """The profiles that belong to the files as they are."""
    try:
        kept = profiles.read(spark)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], profiles.schema)
    return kept.join(now, _same(kept, now, table.partition_column), "left_semi")


def _same(a: DataFrame, b: DataFrame, by: str) -> Column:
    equal = (a[c] == b[c] for c in ("files", "names"))
    return reduce(lambda x, y: x & y, equal, a[f"`{by}`"].eqNullSafe(b[f"`{by}`"]))


def _of(rows: DataFrame, by: str, values: Sequence[str | None]) -> DataFrame:
    chosen = quoted(by).cast("string").isin(*(v for v in values if v is not None))
    return rows.filter(chosen | quoted(by).isNull() if None in values else chosen)


def check_landed(
    spark: SparkSession,
    table: Table,
    profiles: PathTable,
    rules: Sequence[MaxPercentile],
    accuracy: int = ACCURACY,
) -> list[LandedResult]:
    """The verdict of each rule over all rows of the table.

    Profiles are brought up to date first. An empty table, or a column without numbers, fails.
    """
    if not rules:
        return []
    refresh_profiles(spark, table, profiles, [r.column for r in rules], accuracy)
    now = _files_by_partition(spark, table)
    held = _current(spark, table, profiles, now).filter((F.col("accuracy") == accuracy) & (F.col("numbers") > 0))
    rows, by, slack = table.read(spark), table.partition_column, margin(accuracy)
    names = [field_of(rows, rule.column).name for rule in rules]
    merged = held.agg(*(_merged(by, n, r).alias(f"{i}") for i, (n, r) in enumerate(zip(names, rules))))
    found = merged.select(*(_read_off(F.col(f"`{i}`"), rule, slack).alias(f"{i}") for i, rule in enumerate(rules)))
    return [
        _verdict(rows, by, name, rule, slack, about)
        for name, rule, about in zip(names, rules, found.first())
    ]


def landed_quantiles(
    spark: SparkSession, table: Table, rules: Sequence[MaxPercentile], results: Sequence[LandedResult]
) -> list[float | None]:
    """The exact quantiles, which one pass over the rows settles within the brackets of ``check_landed``."""
    wanted = [(field_of(table.read(spark), rule.column).name, rule.p) for rule in rules]
    sketches = [Row(n=r.numbers, lo=r.low, hi=r.high) for r in results]
    return settled_quantiles(table.read(spark), wanted, sketches)


def _merged(by: str, column: str, rule: MaxPercentile) -> Column:
    """An aggregate of the profiles: what lies wholly at or below the maximum, and what may not."""
    here = F.col("column") == column
    below = here & (F.col("hi") <= rule.maximum)
    between = here & (F.col("lo") <= rule.maximum) & (F.col("hi") > rule.maximum)

    def numbers(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("numbers"))), F.lit(0))

    return F.struct(
        numbers(here).alias("n"),
        numbers(below).alias("below"),
        numbers(between).alias("between"),
        F.min(F.when(here, F.col("lo"))).alias("lo"),
        F.max(F.when(here, F.col("hi"))).alias("hi"),
        F.kll_merge_agg_double(F.when(here, F.col("sketch"))).alias("all"),
        F.kll_merge_agg_double(F.when(between, F.col("sketch"))).alias("some"),
        F.collect_list(F.when(between, F.struct(quoted(by).alias("v")))).alias("values"),
    )


def _read_off(merged: Column, rule: MaxPercentile, slack: float) -> Column:
    """The bracket of the quantile, and the share at or below the maximum of what lies between."""

    def quantile(p: float) -> Column:
        return F.when(merged["n"] > 0, F.kll_sketch_get_quantile_double(merged["all"], F.lit(p)))

    low, high = rule.p - slack, rule.p + slack
    share = F.kll_sketch_get_rank_double(merged["some"], F.lit(rule.maximum))
    return F.struct(
        *(merged[c].alias(c) for c in ("n", "below", "between", "values")),
        (quantile(low) if low > 0.0 else merged["lo"]).alias("low"),
        (quantile(high) if high < 1.0 else merged["hi"]).alias("high"),
        F.when(merged["between"] > 0, share).alias("share"),
    )


def _verdict(
    rows: DataFrame, by: str, column: str, rule: MaxPercentile, slack: float, about: Row
) -> LandedResult:
    need = max(1, math.ceil(rule.p * about.n))
    least = most = about.below
    if about.between:
        least += max(0.0, about.share - slack) * about.between
        most += min(1.0, about.share + slack) * about.between
    counted, ok = 0, least >= need
    if not about.n or math.isnan(rule.maximum):
        ok = False
    elif not ok and most >= need:
        values = [v.v for v in about["values"]]
        value = quoted(column).cast("double")
        within = _of(rows, by, values).filter(is_number(value) & (value <= F.lit(rule.maximum)))
        counted, ok = len(values), about.below + within.count() >= need
    return LandedResult(rule, ok, about.n, about.low, about.high, counted)
