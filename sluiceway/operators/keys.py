"""Key columns of a merge: names, null-safe comparison, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import is_orderable, quoted

_RANK = "__key_rank"


def row_keys(
    keys: Sequence[str], schema: T.StructType, partition_column: str
) -> list[str]:
    """The keys as the table spells them; within one partition its column adds nothing."""
    spelling = {name.lower(): name for name in schema.names}
    unknown = [k for k in keys if k.lower() not in spelling]
    if unknown:
        raise ValueError(f"key columns the table does not have: {unknown}")
    found = dict.fromkeys(spelling[k.lower()] for k in keys)
    found.pop(partition_column, None)
    if not found:
        raise ValueError("a merge needs at least one key column besides the partition")
    return list(found)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a ``null_safe`` frame; running it fails if a key is on more than one.

    The check rides on the shuffle of the join that follows. Two rows per key are enough
    to tell, so no more of them leave a map task.
    """
    by = [*keys, *null_flags(keys)]
    rank = F.row_number().over(Window.partitionBy(*map(quoted, by)).orderBy(quoted(by[0])))
    shown = (F.coalesce(nullable_key(k, keys).cast("string"), F.lit("null")) for k in keys)
    repeated = F.concat(
        F.lit("the source of a merge holds a key more than once: "), F.concat_ws(", ", *shown)
    )
    first = F.when(F.col(_RANK) == 1, True).otherwise(F.raise_error(repeated).cast("boolean"))
    return df.withColumn(_RANK, rank).filter((F.col(_RANK) <= 2) & first).drop(_RANK)


def null_flags(keys: Sequence[str]) -> list[str]:
    return [f"__null_{i}" for i in range(len(keys))]


def null_safe(df: DataFrame, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Turn each key into a value that is never null and a flag that says it was.

    Plain equality on the pair is null-safe equality on the key, and as both are plain
    columns the shuffle that removes duplicates also serves the join.
    """
    flags = dict(zip(null_flags(keys), (quoted(k).isNull() for k in keys)))
    filled = {k: F.coalesce(quoted(k), _filler(schema[k].dataType)) for k in keys}
    rest = [quoted(c) for c in df.columns if c not in keys]
    return df.select(
        *(value.alias(name) for name, value in {**filled, **flags}.items()), *rest
    )


def nullable_key(name: str, keys: Sequence[str]) -> Column:
    """The key as it was before ``null_safe``."""
    flag = null_flags(keys)[list(keys).index(name)]
    return F.when(~F.col(flag), quoted(name))


def _filler(data_type: T.DataType) -> Column:
    """Any one value of the type.

    Inside a struct or an array nulls are values as others, in groups and in joins, so only the
    key as a whole needs one. Maps have no order, and so cannot be keys.
    """
    if isinstance(data_type, T.StructType) and data_type.fields:
        return F.struct(*(_filler(f.dataType).alias(f.name) for f in data_type)).cast(data_type)
    if isinstance(data_type, T.ArrayType) and is_orderable(data_type):
        return F.array().cast(data_type)
    if isinstance(data_type, T.DayTimeIntervalType):
        return F.expr("interval '0' second").cast(data_type)
    if isinstance(data_type, T.YearMonthIntervalType):
        return F.expr("interval '0' month").cast(data_type)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(data_type)
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.lit("").cast(data_type)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return F.lit(0).cast(data_type)
    raise TypeError(f"cannot use a {data_type.simpleString()} column as a key")
