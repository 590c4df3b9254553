"""Evaluate every rule of an item in one pass: a report, or a gate that raises."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluiceway.functions.columns import field_of, quoted
from sluiceway.functions.text import double_text
from sluiceway.operators.quantile import settled_quantiles, sketch_of
from sluiceway.operators.rules import MaxPercentile, Rule
from sluiceway.workspace import fresh_path, remove


class QualityError(RuntimeError):
    """The gate is shut; ``results`` holds the outcome of every rule."""

    def __init__(self, message: str, results: list[RuleResult]):
        super().__init__(message)
        self.results = results


@dataclass(frozen=True)
class RuleResult:
    rule: Rule
    observed: float | None
    ok: bool

    @property
    def name(self) -> str:
        return self.rule.name

    @property
    def details(self) -> dict[str, str]:
        missing = "NaN" if isinstance(self.rule, MaxPercentile) else "null"
        text = missing if self.observed is None else double_text(self.observed)
        return {self.rule.detail: text}


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: ``rule, rule_type, column, observed, threshold, ok``.

    All rules share a single aggregation, whose state is a few counters per task and a sketch
    for each ``max_percentile`` rule. If there is one of these, the report is measured while it
    is built, and a second pass settles the observed quantiles.
    """
    if not rules:
        raise ValueError("no rules to report on")
    totals = _totals(df, rules)
    wanted = _percentiles(df, rules)
    quantiles: dict[int, float | None] = {}
    if wanted:
        totals = df.sparkSession.createDataFrame(totals.toArrow(), totals.schema)
        quantiles = _settled(df, wanted, totals, list(wanted))
    return _outcomes(totals, rules, quantiles).drop("position")


def _percentiles(df: DataFrame, rules: Sequence[Rule]) -> dict[int, tuple[str, float]]:
    """Column and share of every ``max_percentile`` rule, by its place."""
    return {
        i: (field_of(df, rule.column).name, rule.p)
        for i, rule in enumerate(rules)
        if isinstance(rule, MaxPercentile)
    }


def _totals(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row with the aggregates of all rules and the sketches of their percentiles."""
    return df.agg(*_aggregates(df, rules))


def _aggregates(df: DataFrame, rules: Sequence[Rule]) -> list[Column]:
    aggregates = [
        expression.alias(f"{i}_{key}")
        for i, rule in enumerate(rules)
        for key, expression in rule.aggregates(df).items()
    ]
    sketches = [sketch_of(*w).alias(f"{i}_sketch") for i, w in _percentiles(df, rules).items()]
    return [*aggregates, *sketches]


def _settled(
    df: DataFrame, wanted: Mapping[int, tuple[str, float]], totals: DataFrame, places: Sequence[int]
) -> dict[int, float | None]:
    """The exact quantiles of the rules in these places, measured together."""
    if not places:
        return {}
    sketches = totals.select(*(F.col(f"`{i}_sketch`") for i in places)).first()
    return dict(zip(places, settled_quantiles(df, [wanted[i] for i in places], list(sketches))))


def _outcomes(
    totals: DataFrame, rules: Sequence[Rule], quantiles: Mapping[int, float | None]
) -> DataFrame:
    def outcome(i: int, rule: Rule) -> Column:
        def aggregate(key: str) -> Column:
            return F.col(f"`{i}_{key}`")

        observed = F.lit(quantiles[i]) if i in quantiles else rule.observed(aggregate)
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(rule.name).alias("rule"),
            F.lit(rule.rule_type).alias("rule_type"),
            F.lit(rule.column).alias("column"),
            observed.cast("double").alias("observed"),
            F.lit(float(rule.threshold)).alias("threshold"),
            rule.passes(aggregate).alias("ok"),
        )

    outcomes = F.array(*(outcome(i, rule) for i, rule in enumerate(rules)))
    return totals.select(F.inline(outcomes))


def check(df: DataFrame, rules: Sequence[Rule]) -> list[RuleResult]:
    """Evaluate the rules; a quantile is settled only for a rule that failed on it."""
    if not rules:
        return []
    totals = _totals(df, rules)
    totals = df.sparkSession.createDataFrame(totals.toArrow(), totals.schema)  # one row
    return _results(df, rules, totals)


def _results(df: DataFrame, rules: Sequence[Rule], totals: DataFrame) -> list[RuleResult]:
    rows = sorted(_outcomes(totals, rules, {}).collect(), key=lambda row: row.position)
    results = [RuleResult(rule, row.observed, row.ok) for rule, row in zip(rules, rows)]
    wanted = _percentiles(df, rules)
    failed = [i for i in wanted if not results[i].ok]
    for i, quantile in _settled(df, wanted, totals, failed).items():
        results[i] = replace(results[i], observed=quantile)
    return results


def failure_message(results: Sequence[RuleResult]) -> str | None:
    """The text that names every failed rule, or None if all passed."""
    failed = [r for r in results if not r.ok]
    if not failed:
        return None
    described = (
        f"{r.name} details=Map({', '.join(f'{k} -> {v}' for k, v in r.details.items())})"
        for r in failed
    )
    return "DQ failed: " + "; ".join(described)


def gate(df: DataFrame, rules: Sequence[Rule], fail_fast: bool = True) -> list[RuleResult]:
    """Evaluate all rules, then raise once with every failure; no row is ever dropped.

    With ``fail_fast=False`` the results come back whatever they are.
    """
    results = check(df, rules)
    if fail_fast:
        _raise_failures(results)
    return results


def _raise_failures(results: list[RuleResult]) -> None:
    message = failure_message(results)
    if message:
        raise QualityError(message, results)


def staged_check(df: DataFrame, rules: Sequence[Rule], path: str) -> tuple[DataFrame, list[RuleResult]]:
    """Write ``df`` to ``path`` as Parquet and evaluate the rules over the rows as they pass.

    Gives the rows as written, and the results; ``df`` is read once. Only a quantile that
    failed is settled by a second pass, over the written rows.
    """
    untyped = {f.name: quoted(f.name).cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)}
    df = df.withColumns(untyped) if untyped else df  # Parquet has no such type
    spark = df.sparkSession
    if not rules:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), []
    schema = _totals(df, rules).schema
    seen = Observation()
    df.observe(seen, *_aggregates(df, rules)).write.parquet(path)
    row = {name: _plain(value) for name, value in seen.get.items()}
    totals = pa.Table.from_pylist([row], schema=to_arrow_schema(schema))
    staged = spark.read.schema(df.schema).parquet(path)
    return staged, _results(staged, rules, spark.createDataFrame(totals, schema))


def _plain(value):
    return value.asDict() if isinstance(value, Row) else value


@contextmanager
def staged_gate(df: DataFrame, rules: Sequence[Rule]) -> Iterator[tuple[DataFrame, list[RuleResult]]]:
    """The gate over rows that are read once: they are written aside while they are checked.

    Within the context the written rows can be used; they are deleted at its end, and at once
    if the gate is shut. They lie in the folder of ``spark.checkpoint.dir``; on a cluster that
    names none, ``df`` itself is checked first and then read again.
    """
    try:
        path = fresh_path(df.sparkSession, "staged")
    except RuntimeError:
        yield df, gate(df, rules)
        return
    try:
        staged, results = staged_check(df, rules, path)
        _raise_failures(results)
        yield staged, results
    finally:
        remove(df.sparkSession, path)
