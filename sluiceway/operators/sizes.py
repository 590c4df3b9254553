"""How large a frame is as Spark rows, to tell whether it may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import quoted

# A frame of at most this many rows and bytes may be broadcast.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20

_WORD = 8


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a frame, counted in one aggregation."""
    fixed = _WORD * (len(df.columns) + 2 + len(df.columns) // 64)
    held = sum((_beyond(quoted(f.name), f.dataType) for f in df.schema), F.lit(fixed).cast("long"))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("bytes")).first()
    return found["n"], found["bytes"] or 0


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int | None = None) -> bool:
    """Whether a frame has at most so many rows and bytes."""
    n, held = measured(df)
    return n <= rows and held <= (SMALL_BYTES if size is None else size)


def _beyond(value: Column, data_type: T.DataType) -> Column:
    """Bytes a value takes besides its word in the row; a null takes none."""
    none = F.lit(0).cast("long")
    if isinstance(data_type, T.StructType):
        inner = (_WORD + _beyond(value.getField(f.name), f.dataType) for f in data_type)
        found = sum(inner, F.lit(2 * _WORD).cast("long"))
    elif isinstance(data_type, T.ArrayType):
        found = _elements(value, data_type.elementType)
    elif isinstance(data_type, T.MapType):
        found = _elements(F.map_keys(value), data_type.keyType) + _elements(
            F.map_values(value), data_type.valueType
        )
    elif isinstance(data_type, (T.StringType, T.BinaryType)):
        found = F.octet_length(value).cast("long") + _WORD
    elif isinstance(data_type, T.AtomicType) and not isinstance(data_type, T.DecimalType):
        return none
    else:
        found = F.lit(2 * _WORD).cast("long")
    return F.when(value.isNull(), none).otherwise(found)


def _elements(values: Column, element: T.DataType) -> Column:
    each = F.size(values).cast("long") * (_WORD + 1) + 3 * _WORD
    if isinstance(element, T.AtomicType) and not isinstance(element, (T.StringType, T.BinaryType)):
        return each
    total = F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + _beyond(x, element))
    return each + total
