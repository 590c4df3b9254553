"""Column expressions shared by the projections and the quality rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = {
    "gt": lambda value, bound: value > bound,
    "gte": lambda value, bound: value >= bound,
    "lt": lambda value, bound: value < bound,
    "lte": lambda value, bound: value <= bound,
    "eq": lambda value, bound: value == bound,
    "neq": lambda value, bound: value != bound,
}


def quoted(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_of(df: DataFrame, name: str) -> T.StructField:
    """Find a field by name: an exact match first, else the only match ignoring case."""
    exact = [f for f in df.schema.fields if f.name == name]
    found = exact or [f for f in df.schema.fields if f.name.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"column {name!r} matches {len(found)} of {df.columns}")
    return found[0]


def spelled_like(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename columns that differ from one of ``names`` in case alone."""
    spelling = {name.lower(): name for name in names}
    renamed = {c: spelling.get(c.lower(), c) for c in df.columns if c not in names}
    return df.withColumnsRenamed(renamed)


def event_date(column: str, ds: str) -> Column:
    """Date part of a date string; the run date where it is missing or not a date.

    ``try_to_date`` gives null for a bad string whether or not the session is in
    ANSI mode.
    """
    return F.coalesce(F.try_to_date(quoted(column)), F.lit(ds).try_cast("date"))


def is_filled(field: T.StructField) -> Column:
    """Whether a value counts as present, by type.

    Strings need a character other than a space, floats must not be NaN, any other
    type must not be null. Never null itself.
    """
    value = quoted(field.name)
    if isinstance(field.dataType, T.StringType):
        return value.isNotNull() & (F.length(F.trim(value)) > 0)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def number_meets(field: T.StructField, op: str, bound: float) -> Column:
    """Whether a value is a real number that compares to ``bound`` as ``op`` asks.

    NaN is excluded first: Spark orders it above every number and equal to itself,
    so ``NaN > bound`` alone would hold.
    """
    if op not in COMPARISONS:
        raise ValueError(f"Unsupported op '{op}' (use {','.join(COMPARISONS)})")
    number = quoted(field.name).try_cast("double")
    return (
        number.isNotNull() & ~F.isnan(number) & COMPARISONS[op](number, F.lit(bound))
    )


def is_orderable(data_type: T.DataType) -> bool:
    """Whether Spark can sort by the type (a map anywhere inside rules that out)."""
    if isinstance(data_type, T.StructType):
        return all(is_orderable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return is_orderable(data_type.elementType)
    return not isinstance(data_type, (T.MapType, T.VariantType))
