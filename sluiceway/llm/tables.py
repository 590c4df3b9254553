"""Intermediate tables in the shared folder, and joins that hot keys cannot overload."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.workspace import fresh_path

HOT_SHARE = 1000
_BUCKETS = 1 << 20
_BATCH = "4m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python at about ``_BATCH`` at a time, where the session names no bound of its own.

    Spark counts rows alone, 10,000 to a batch, whatever their texts hold; each task has a batch several
    times, in the executor's native memory and in Python.
    """
    if spark.conf.get(_BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_BYTES, _BATCH)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder, which outlives executors, and read it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def look_up(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has each key once and is read twice.

    ``count`` says how many rows have the key. Keys with a thousandth of all rows number a
    thousand at most: they are joined by broadcast, so no task gets all rows of such a key;
    the rest are shuffled. Both keys are strings, and the table's columns are narrow.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) >= max(1, total / HOT_SHARE)
    names = [c for c in table.columns if c != key]
    hot = table.filter(large).select(key, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in names))
    rest = table.filter(~large).select(F.col(key).alias("__key"), *(F.col(c).alias(f"__rest_{c}") for c in names))
    # Rows already found, and those without a key, get keys of their own, which no key equals.
    other = F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(
        F.concat(F.lit("found "), F.monotonically_increasing_id())
    )
    return (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("__key", other)
        .join(rest, "__key", "left")
        .select(
            *rows.columns,
            *(F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(f"__rest_{c}")).alias(c) for c in names),
        )
    )


def likely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be in the one column of ``ids``: all that are, and few others if ids are few.

    Keys are hashed into about a million buckets; those that ids fall in, at most all, are
    broadcast. It spares a shuffle of texts that a join would then drop.
    """

    return _bucketed(rows, key).join(_buckets(ids), "__bucket", "left_semi").drop("__bucket")


def unlikely(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows that ``likely`` leaves out; their key is not among ``ids``."""
    return _bucketed(rows, key).join(_buckets(ids), "__bucket", "left_anti").drop("__bucket")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is null or not in the one column of ``ids``."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    there = likely(rows, ids, key)
    return unlikely(rows, ids, key).unionByName(there.join(gone, there[key] == gone["__gone"], "left_anti"))


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(_BUCKETS)).cast("int")


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("__bucket", _bucket(key))


def _buckets(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids.select(_bucket(ids.columns[0]).alias("__bucket")).distinct())


def each_group(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of two rows and more of a partition sorted by integer ``keys``.

    It is what ``applyInPandas`` does, at a fraction of its cost where groups are small and many.
    """
    held: dict[str, np.ndarray] | None = None
    for frame in frames:
        if frame.empty:
            continue
        now = {c: frame[c].to_numpy() for c in frame.columns}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        new = np.zeros(len(now[keys[0]]), bool)
        for key in keys:
            new[1:] |= now[key][1:] != now[key][:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for low, high in zip(edges, edges[1:]):
            if high - low > 1:
                yield {c: v[low:high] for c, v in now.items()}
        held = {c: v[edges[-1] :] for c, v in now.items()}
    if held is not None and len(held[keys[0]]) > 1:
        yield held


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], size: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """The columns of whole groups of a partition sorted by integer ``keys``, ``size`` rows and more at a time.

    With them go the groups' numbers from 0, for each row.
    """

    def numbers(now: dict[str, np.ndarray]) -> np.ndarray:
        new = np.zeros(len(now[keys[0]]), bool)
        for key in keys:
            new[1:] |= now[key][1:] != now[key][:-1]
        return np.cumsum(new)

    held: list[dict[str, np.ndarray]] = []
    n = 0
    for frame in frames:
        if frame.empty:
            continue
        held.append({c: frame[c].to_numpy() for c in frame.columns})
        n += len(frame)
        if n < size or all(held[0][k][0] == held[-1][k][-1] for k in keys):
            continue
        now = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        group = numbers(now)
        cut = int(np.searchsorted(group, group[-1]))
        yield {c: v[:cut] for c, v in now.items()}, group[:cut]
        held, n = [{c: v[cut:] for c, v in now.items()}], len(group) - cut
    if held:
        now = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        yield now, numbers(now)


def numbered(rows: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``number``, their place from 0 within their group in a total order.

    ``order`` begins with the columns of ``group``. One shuffle by range puts the rows in order,
    whatever a group holds; rows that are equal in it are dealt by a number of their own. A
    row's place is then that in its partition and the rows of its group in partitions before,
    of which there are as many counts as partitions and groups at most. Nulls are equal.
    """
    group = group or []
    # Numbers of one partition follow one another, so their bits are mixed to spread equal rows.
    spread = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [*order, F.col("__tie")]
    placed = spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    placed = saved(placed.withColumn("__at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("__at", 33)
    starts = placed.groupBy(part.alias("__part"), *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    if group:
        before = Window.partitionBy(*group).orderBy("__part")
    else:  # a row for each partition
        before = Window.partitionBy(F.lit(0)).orderBy("__part")
    earlier = F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(
        F.col("__part").alias("__in"),
        *(F.col(c).alias(f"__of_{c}") for c in group),
        (earlier - F.col("__first")).alias("__shift"),
    )
    same = part == F.col("__in")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("number"))


def by_row(docs: DataFrame, row: str = "__row") -> DataFrame:
    """``docs`` with a number for each row, in order of doc_id, null first.

    It is the doc_id where each row has one of its own. Otherwise rows are numbered and written,
    so that rows that share an id, or all their columns, can be told apart.
    """
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if counts.isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    # Rows that differ are numbered alike in every run; of equal ones it does not matter.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(*docs.columns)]
    return numbered(docs, order).withColumnRenamed("number", row)
