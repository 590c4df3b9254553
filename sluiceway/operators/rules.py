"""Data-quality rules as aggregate expressions, and the factory that reads them from metadata.

A rule names the aggregates it needs and, from their results, gives a verdict. It
never runs a query itself, so any number of rules share one pass over the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.columns import field_of, is_filled, number_meets, quoted
from sluiceway.functions.text import double_text
from sluiceway.operators.quantile import is_number, rank_of


def _share_of_rows(condition: Column) -> Column:
    """Share of all rows, nulls included; null when there are no rows."""
    return F.try_divide(F.count_if(condition), F.count(F.lit(1)))


class _RatioRule:
    """At least ``minimum`` of all rows must meet the condition."""

    detail: ClassVar[str] = "observed"

    @property
    def threshold(self) -> float:
        return self.minimum

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"ratio": _share_of_rows(self.condition(df))}

    def observed(self, aggregate: Callable[[str], Column]) -> Column:
        return aggregate("ratio")

    def passes(self, aggregate: Callable[[str], Column]) -> Column:
        return F.coalesce(aggregate("ratio") >= F.lit(self.minimum), F.lit(False))


@dataclass(frozen=True)
class FilledRatio(_RatioRule):
    column: str
    minimum: float
    rule_type: ClassVar[str] = "filled_ratio"

    @property
    def name(self) -> str:
        return f"filled_ratio({self.column})>={double_text(self.minimum)}"

    def condition(self, df: DataFrame) -> Column:
        return is_filled(field_of(df, self.column))


@dataclass(frozen=True)
class ValueRatio(_RatioRule):
    column: str
    op: str
    bound: float
    minimum: float
    rule_type: ClassVar[str] = "value_ratio"

    @property
    def name(self) -> str:
        return (
            f"value_ratio({self.column} {self.op} {double_text(self.bound)})"
            f">={double_text(self.minimum)}"
        )

    def condition(self, df: DataFrame) -> Column:
        return number_meets(field_of(df, self.column), self.op, self.bound)


@dataclass(frozen=True)
class MaxPercentile:
    """The ``p``-quantile of a numeric column must be at most ``maximum``.

    That holds exactly when at least ceil(p * n) of the n numbers are at or below
    ``maximum``, so the verdict needs two counts and no quantile. The quantile itself
    is only for people to read; see ``exact_quantiles``.
    """

    column: str
    p: float
    maximum: float
    rule_type: ClassVar[str] = "max_percentile"
    detail: ClassVar[str] = "approx_quantile"

    @property
    def name(self) -> str:
        return (
            f"max_percentile({self.column},p={double_text(self.p)})"
            f"<={double_text(self.maximum)}"
        )

    @property
    def threshold(self) -> float:
        return self.maximum

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        field = field_of(df, self.column)
        if not isinstance(field.dataType, T.NumericType):
            raise TypeError(
                f"{self.name}: column must be numeric, is {field.dataType.simpleString()}"
            )
        value = quoted(field.name).cast("double")
        return {
            "numbers": F.count_if(is_number(value)),
            "within": F.count_if(is_number(value) & (value <= F.lit(self.maximum))),
        }

    def observed(self, aggregate: Callable[[str], Column]) -> Column:
        return F.lit(None).cast("double")

    def passes(self, aggregate: Callable[[str], Column]) -> Column:
        if math.isnan(self.maximum):
            return F.lit(False)
        numbers, within = aggregate("numbers"), aggregate("within")
        return (numbers > 0) & (within >= rank_of(self.p, numbers))


@dataclass(frozen=True)
class MalformedRatio:
    """At most ``maximum`` of all rows may have a line in ``column``, as ``read_csv`` gives malformed ones."""

    column: str
    maximum: float
    rule_type: ClassVar[str] = "malformed_ratio"
    detail: ClassVar[str] = "observed"

    @property
    def name(self) -> str:
        return f"malformed_ratio({self.column})<={double_text(self.maximum)}"

    @property
    def threshold(self) -> float:
        return self.maximum

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"ratio": _share_of_rows(quoted(field_of(df, self.column).name).isNotNull())}

    def observed(self, aggregate: Callable[[str], Column]) -> Column:
        return aggregate("ratio")

    def passes(self, aggregate: Callable[[str], Column]) -> Column:
        return F.coalesce(aggregate("ratio") <= F.lit(self.maximum), F.lit(False))


Rule = FilledRatio | ValueRatio | MaxPercentile | MalformedRatio


def build_rules(specs: Iterable[tuple[str, Mapping[str, str]]]) -> list[Rule]:
    """Turn ``(rule type, params)`` pairs into rules; raise on anything malformed."""
    return [_build_rule(rule_type, params) for rule_type, params in specs]


def _build_rule(rule_type: str, params: Mapping[str, str]) -> Rule:
    def required(key: str) -> str:
        if params.get(key) is None:
            raise ValueError(f"Missing parameter '{key}'")
        return params[key]

    def number(key: str) -> float:
        return float(required(key))

    def share(key: str) -> float:
        value = number(key)
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"{rule_type}.{key} must be in [0,1], got {double_text(value)}")
        return value

    if rule_type == FilledRatio.rule_type:
        return FilledRatio(required("column"), share("min"))
    if rule_type == ValueRatio.rule_type:
        return ValueRatio(
            required("column"), required("op").lower(), number("value"), share("min")
        )
    if rule_type == MaxPercentile.rule_type:
        p = number("p")
        if not 0.0 < p <= 1.0:
            raise ValueError(f"max_percentile.p must be in (0,1], got {double_text(p)}")
        return MaxPercentile(required("column"), p, number("max"))
    if rule_type == MalformedRatio.rule_type:
        return MalformedRatio(required("column"), share("max"))
    raise ValueError(f"Unknown DQ rule: {rule_type}")
