"""Replace one partition or the rows of a predicate, or upsert by key into partitions or files."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import quoted, spelled_like
from sluiceway.operators.dedupe import keep_latest
from sluiceway.operators.keys import (
    null_flags,
    null_safe,
    nullable_key,
    require_unique,
    row_keys,
)
from sluiceway.operators.sizes import SMALL_ROWS, is_small
from sluiceway.operators.skew import HOT_ROWS, PARTS, hot_keys
from sluiceway.operators.staging import only_partition
from sluiceway.sources.tables import FILE, Buckets, Table

_MATCHED = "__in_source"
_SIDE = "__side"
_OVER = "__over"
_PART = "__part"
# Names of helper columns, which a table must not have.
_OWN = re.compile(r"__(in_source|side|over|part|parts|bucket|n|key_rank|file|null_\d+)", re.IGNORECASE)


def overwrite_partition(df: DataFrame, table: Table, value: str) -> None:
    """Replace one partition with the rows of ``df`` that belong to it.

    Rows of other partitions are dropped and other partitions of the table stay. With
    no rows to write, the partition stays as it is.
    """
    _require_value(value)
    schema = table.columns(df.sparkSession)
    df = _in_table_terms(df, schema)
    absent = [n for n in schema.names if n not in df.columns]
    if absent:
        raise ValueError(f"columns missing from the source: {absent}")
    rows = only_partition(df, value, table.partition_column)
    table.switch_partitions(_filed_under(_cast(rows, schema), value, table, schema), [value])


def merge_partition(
    df: DataFrame,
    table: Table,
    keys: Sequence[str],
    value: str,
    latest_by: Sequence[str] | None = None,
    stamp: bool = False,
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> None:
    """Upsert ``df`` into one partition: update matched keys, insert the rest, keep the others.

    With ``latest_by`` the source is first reduced to its latest row per key; without,
    the merge fails, and writes nothing, if a key repeats. With ``stamp`` every row is filed under ``value``;
    without, rows of other partitions are dropped. ``hot_rows`` and ``small_rows`` only
    choose how the join runs; see ``upsert``.
    """
    _require_value(value)
    spark = df.sparkSession
    column = table.partition_column
    schema = table.columns(spark)
    df = _in_table_terms(df, schema)
    source = df if stamp else only_partition(df, value, column)
    merged = upsert(
        source,
        table.read_partition(spark, value),
        schema,
        keys,
        column,
        latest_by=latest_by,
        hot_rows=hot_rows,
        small_rows=small_rows,
        buckets=table.buckets(spark),
    )
    table.switch_partitions(_filed_under(merged, value, table, schema), [value])


def merge_partitions(
    df: DataFrame,
    table: Table,
    keys: Sequence[str],
    latest_by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> list[str]:
    """As ``merge_partition``, for all partitions that ``df`` has rows of, in one run: a backfill.

    Rows meet by partition and key, so a key may be in several partitions. Only the files of
    these partitions are listed and read. Gives their values, which the driver holds; a row
    without one is refused.
    """
    spark = df.sparkSession
    column = table.partition_column
    schema = table.columns(spark)
    df = _in_table_terms(df, schema)
    keys = row_keys(keys, schema, column)
    df = df.withColumn(column, quoted(column).cast(schema[column].dataType))
    values = sorted((r[0] for r in df.select(quoted(column).cast("string")).distinct().collect()), key=str)
    for value in values:
        _require_value(value)
    if not values:
        return []
    # The partition column is a key as any other here.
    merged = upsert(
        df,
        table.read_partitions(spark, values),
        schema,
        [column, *keys],
        "",
        latest_by=latest_by,
        hot_rows=hot_rows,
        small_rows=small_rows,
    )
    # A task writes a file for each partition it has rows of, so the rows of one come together;
    # what is too much for a task is split.
    table.switch_partitions(merged.hint("rebalance", quoted(column)), values)
    return values


def merge_into_files(
    df: DataFrame,
    table: Table,
    keys: Sequence[str],
    value: str,
    latest_by: Sequence[str] | None = None,
    stamp: bool = False,
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
) -> int:
    """As ``merge_partition``, but only files that hold a key of the source are rewritten.

    The source's keys are looked up among the keys of the partition, a read of those columns
    alone; the files hit are merged, and all others stay byte for byte. Worth it where a run touches few
    files, as corrections of a recent day do in files sorted by key. Gives how many were
    rewritten. The driver holds the names of the files hit.
    """
    _require_value(value)
    spark = df.sparkSession
    column = table.partition_column
    schema = table.columns(spark)
    df = _in_table_terms(df, schema)
    source = df if stamp else only_partition(df, value, column)
    keys = row_keys(keys, schema, column)
    data = T.StructType([f for f in schema if f.name != column])
    held = only_partition(table.read_with_files(spark), value, column)
    touched = _files_with_keys(held, source, keys, data, small_rows)
    merged = upsert(
        _cast(source, data),
        _rows_in(held, touched) if touched else None,
        schema,
        keys,
        column,
        latest_by=latest_by,
        hot_rows=hot_rows,
        small_rows=small_rows,
    )
    table.swap_files(touched, _filed_under(merged, value, table, schema))
    return len(touched)


def _files_with_keys(
    held: DataFrame, source: DataFrame, keys: Sequence[str], data: T.StructType, small_rows: int
) -> list[str]:
    """The files of ``held`` with a key of the source."""
    by = [*keys, *null_flags(keys)]
    wanted = null_safe(_cast(source, data), keys, data).select(*map(quoted, by)).distinct()
    if is_small(wanted, small_rows):
        wanted = F.broadcast(wanted)
    at = null_safe(held.select(*map(quoted, [*keys, FILE])), keys, data)
    return _files(at.join(wanted, by, "left_semi"))


def _files(rows: DataFrame) -> list[str]:
    return sorted(r[0] for r in rows.select(FILE).distinct().collect())


def _rows_in(held: DataFrame, files: Sequence[str]) -> DataFrame:
    """The rows of these files; Spark does not open the others."""
    return held.filter(F.col("_metadata.file_path").isin(*files)).drop(FILE)


def overwrite_where(df: DataFrame, table: Table, predicate: Column | str) -> int:
    """Replace the rows that meet ``predicate``, in whatever partitions, with those of ``df``.

    All rows of ``df`` must meet it too; it fails, and writes nothing, if one does not. A file that
    holds no such row is left alone, and of the others the remaining rows are written again.
    A predicate that is null for a row does not meet it. Gives how many files were replaced;
    the driver holds their names.
    """
    spark = df.sparkSession
    schema = table.columns(spark)
    df = _in_table_terms(df, schema)
    absent = [n for n in schema.names if n not in df.columns]
    if absent:
        raise ValueError(f"columns missing from the source: {absent}")
    predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
    meets = F.coalesce(predicate, F.lit(False))
    outside = F.raise_error(F.lit("a row to be written does not meet the predicate it replaces"))
    rows = _cast(df, schema).select(*map(quoted, schema.names))
    rows = rows.filter(F.when(meets, True).otherwise(outside.cast("boolean")))
    held = table.read_with_files(spark)
    touched = _files(held.filter(meets))
    if touched:
        rows = rows.unionByName(_rows_in(held, touched).filter(~meets))
    table.swap_files(touched, rows)
    return len(touched)


def upsert(
    source: DataFrame,
    current: DataFrame | None,
    schema: T.StructType,
    keys: Sequence[str],
    partition_column: str,
    latest_by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    small_rows: int = SMALL_ROWS,
    buckets: Buckets | None = None,
) -> DataFrame:
    """The rows of a partition after a merge, without the partition column.

    A row of ``current`` whose key is in ``source`` takes the source's columns and keeps
    its key and any column the source lacks; a source row without a match is added.
    Null keys match null keys. A key that ``current`` holds more than once is updated in
    each of its rows.

    Both sides are read and shuffled by key once, and there is no join: in a group of a key, the
    one source row comes first, each current row after it takes its columns, and it is
    itself kept if no current row follows. A group is a window, which spills what does not
    fit in memory. Sizes that are measured first choose between ways to the same rows:

    * no current rows: the source as it is;
    * up to ``hot_rows`` of them: as above;
    * ``buckets`` that ``current`` lies in, by some of the keys, and no key with over ``hot_rows``: the
      source goes to its buckets, and the current rows are not shuffled at all;
    * more, and a source of up to ``small_rows`` rows and ``SMALL_BYTES``: the source is
      broadcast and the current rows are not shuffled at all;
    * more, with keys that hold over ``hot_rows`` each: the rows of such a key are split into
      parts, and its one source row is repeated for each of them.
    """
    taken = [n for n in schema.names if _OWN.fullmatch(n)]
    if taken:
        raise ValueError(f"columns with names the merge needs for itself: {taken}")
    keys = row_keys(keys, schema, partition_column)
    data = T.StructType([f for f in schema if f.name != partition_column])
    source = null_safe(_cast(source, data), keys, data)
    join_on = [*keys, *null_flags(keys)]

    def one_per_key(rows: DataFrame) -> DataFrame:
        if latest_by is None:
            rows = require_unique(rows, keys)
        else:
            # The source's own partition value may decide which row is latest.
            rows = keep_latest(rows, join_on, latest_by)
        return rows.drop(partition_column)

    def restored(joined: DataFrame) -> DataFrame:
        return _restore(joined, keys, data)

    held = 0 if current is None else current.count()
    unique = one_per_key(source)
    if not held:
        return restored(unique)

    held_rows = current.drop(partition_column)
    current = null_safe(held_rows, keys, data)
    if held > hot_rows and is_small(source, small_rows):
        return _upsert_few(unique, current, join_on, restored)
    hot = hot_keys(current, join_on, held, hot_rows) if held > hot_rows else None
    if hot is None and buckets and set(buckets.columns) <= set(keys):
        return _upsert_buckets(unique, held_rows, keys, data, buckets)
    if hot is None:
        # Partitioned as the source is, which the union keeps, so that the window shuffles nothing.
        together = _together(unique, current.repartition(*map(quoted, join_on)))
        return restored(_taken_over(together, unique.columns, join_on))
    together = _together(_in_every_part(unique, hot, join_on), _in_parts(current, hot, join_on))
    return restored(_taken_over(together, unique.columns, join_on, _PART))


def _together(unique: DataFrame, current: DataFrame) -> DataFrame:
    return unique.withColumn(_SIDE, F.lit(0)).unionByName(
        current.withColumn(_SIDE, F.lit(1)), allowMissingColumns=True
    )


def _taken_over(
    together: DataFrame, given: Sequence[str], join_on: list[str], part: str | None = None
) -> DataFrame:
    """Current rows with the columns ``given`` of the source row before them, and source rows without any after.

    With ``part``, a key that lies in parts has current rows, so its source rows go.
    """
    group = Window.partitionBy(*map(quoted, [*join_on, *([part] if part else [])])).orderBy(_SIDE)
    so_far = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = F.first(_SIDE).over(so_far) == 0
    values = {
        name: F.when(matched, F.first(quoted(name)).over(so_far)).otherwise(quoted(name))
        for name in given
        if name not in join_on
    }
    alone = F.lead(_SIDE).over(group).isNull()
    if part:
        alone = alone & F.col(PARTS).isNull()
    kept = together.select(
        *(quoted(name) for name in together.columns if name not in values),
        *(value.alias(name) for name, value in values.items()),
        alone.alias(_OVER),
    )
    return kept.filter((F.col(_SIDE) == 1) | F.col(_OVER))


def _upsert_few(
    few: DataFrame,
    current: DataFrame,
    join_on: list[str],
    restored: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Update by a broadcast of the source; add the source rows whose keys are not held."""
    updated = _pair(F.broadcast(few), current, join_on, "right_outer")
    wanted = F.broadcast(few.select(*map(quoted, join_on)))
    matched = current.select(*map(quoted, join_on)).join(wanted, join_on, "left_semi").distinct()
    added = few.join(matched, join_on, "left_anti")
    return restored(updated).unionByName(restored(added))


def _upsert_buckets(
    unique: DataFrame, current: DataFrame, keys: Sequence[str], data: T.StructType, buckets: Buckets
) -> DataFrame:
    """Update where the current rows lie.

    Only plain columns keep a bucketed scan's partitioning, so keys are as they are given here;
    in the groups of a window null equals null.
    """
    given = [c for c in unique.columns if c not in [*keys, *null_flags(keys)]]
    source = unique.select(*(nullable_key(k, keys).alias(k) for k in keys), *map(quoted, given))
    source = source.repartition(buckets.number, *map(quoted, buckets.columns))
    merged = _taken_over(_together(source, current), source.columns, list(keys))
    return merged.select(
        *((quoted(f.name) if f.name in merged.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in data)
    )


def _in_parts(current: DataFrame, hot: DataFrame, join_on: list[str]) -> DataFrame:
    """The rows of hot keys dealt over the parts of their key, all others in part 0."""
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce(PARTS, F.lit(1)))
    return current.join(hot, join_on, "left").withColumn(_PART, part)


def _in_every_part(unique: DataFrame, hot: DataFrame, join_on: list[str]) -> DataFrame:
    """Rows of hot keys once for each part, all others in part 0."""
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce(PARTS, F.lit(1)) - 1)
    return unique.join(hot, join_on, "left").withColumn(_PART, F.explode(parts))


def _require_value(value: str) -> None:
    """A null or empty value names Spark's default folder, which no other value may share."""
    if not value:
        raise ValueError("a partition needs a value that is not empty")


def _pair(source: DataFrame, current: DataFrame, on: list[str], how: str) -> DataFrame:
    marked = source.withColumn(_MATCHED, F.lit(True))
    return marked.alias("s").join(current.alias("t"), on, how)


def _restore(joined: DataFrame, keys: Sequence[str], data: T.StructType) -> DataFrame:
    """Pick each column from its side of the join and put null keys back.

    Rows that never met the current side have only the source's columns.
    """
    sides = joined.columns

    def pick(field: T.StructField) -> Column:
        name = field.name
        if name in keys:
            value = nullable_key(name, keys)
        elif sides.count(name) == 2:
            of_source, of_current = F.col(f"s.`{name}`"), F.col(f"t.`{name}`")
            value = F.when(F.col(_MATCHED), of_source).otherwise(of_current)
        else:
            value = quoted(name) if name in sides else F.lit(None)
        return value.cast(field.dataType).alias(name)

    return joined.select(*map(pick, data))


def _in_table_terms(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Spell columns as the table does; raise on any it does not have."""
    df = spelled_like(df, schema.names)
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"columns the table does not have: {unknown}")
    return df


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give the columns the schema knows its types; leave any other as it is."""
    types = {f.name: f.dataType for f in schema}
    return df.select(
        *(quoted(c).cast(types[c]).alias(c) if c in types else quoted(c) for c in df.columns)
    )


def _filed_under(df: DataFrame, value: str, table: Table, schema: T.StructType) -> DataFrame:
    """Set the partition column, a constant, so that the write needs no sort by it."""
    column = table.partition_column
    return df.withColumn(column, F.lit(value).cast(schema[column].dataType))
