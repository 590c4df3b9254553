"""Exact quantiles of numeric columns without sorting or gathering a column.

A sketch of each column, built in one aggregation that others may share, brackets the wanted
rank. One pass then counts the values below the bracket and, inside it, either each value or,
where it holds too many for one task to rank, even bins; tasks send one row per value or bin.
Bins that still hold many are split further. All wanted quantiles share every pass, and one
row for each reaches the driver. The sketch only decides where to look: the ranks are counted,
and a bracket that should miss its rank is widened to what lies beside it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sluiceway.functions.columns import quoted

# A rank of the sketch is off by no more than this part of all values.
_ACCURACY = 10_000
# Bins per pass.
_EVEN_BINS = 1024
# This many candidates are few enough for one task to rank.
_FEW = 100_000


def is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def rank_of(p: float, count: Column) -> Column:
    """1-based rank of the ``p``-quantile among ``count`` sorted values."""
    return F.greatest(F.ceil(F.lit(p) * count), F.lit(1))


def exact_quantiles(
    df: DataFrame, wanted: Sequence[tuple[str, float]], few: int = _FEW
) -> list[float | None]:
    """For each (column, p): the smallest value with at least ``p`` of the values up to it.

    Null and NaN are ignored; None where nothing is left.
    """
    if any(not 0.0 < p <= 1.0 for _, p in wanted):
        raise ValueError("p must be in (0,1]")
    sketch = df.agg(*(s.alias(f"{k}") for k, (c, p) in enumerate(wanted) for s in [sketch_of(c, p)]))
    return settled_quantiles(df, wanted, list(sketch.first()), few)


def sketch_of(column: str, p: float) -> Column:
    """An aggregate for ``settled_quantiles``: how many numbers, and a bracket of the quantile."""
    value = quoted(column).cast("double")
    number = F.when(is_number(value), value)
    beside = [max(0.0, p - 2 / _ACCURACY), min(1.0, p + 2 / _ACCURACY)]
    ends = F.percentile_approx(number, beside, _ACCURACY)
    return F.struct(F.count(number).alias("n"), ends[0].alias("lo"), ends[1].alias("hi"))


def settled_quantiles(
    df: DataFrame, wanted: Sequence[tuple[str, float]], sketches: Sequence[Row], few: int = _FEW
) -> list[float | None]:
    """The exact quantiles, given what ``sketch_of`` found for each."""
    series, value = F.col("series"), F.col("v")
    there = {k: s for k, s in enumerate(sketches) if s.n}
    if not there:
        return [None] * len(wanted)
    each = (
        F.struct(F.lit(k).alias("series"), quoted(wanted[k][0]).cast("double").alias("v")) for k in there
    )
    values = df.select(F.inline(F.array(*each))).filter(is_number(value))

    def inside(lo: float, hi: float, n: float) -> Column:
        if n <= few or not math.isfinite(hi - lo):
            return value
        return F.floor((value - F.lit(lo)) / F.lit(hi - lo) * F.lit(_EVEN_BINS)).cast("double")

    side = _for_series({k: F.when(value < s.lo, -1).when(value > s.hi, 1).otherwise(0) for k, s in there.items()})
    place = _for_series({k: inside(s.lo, s.hi, 4 / _ACCURACY * s.n) for k, s in there.items()})
    bin_ = F.struct(side.alias("side"), F.when(side == 0, place).alias("place"))
    ranks = {k: (k, F.lit(max(1, math.ceil(wanted[k][1] * s.n)))) for k, s in there.items()}
    found = _locate(_bins(values, bin_), ranks)
    while unsettled := {k: b for k, b in found.items() if b.lo < b.hi}:
        place = _for_series({k: inside(b.lo, b.hi, b.n) for k, b in unsettled.items()})
        bins = _bins(_within(values, unsettled), place)
        found |= _locate(bins, {k: (k, F.lit(b.rank)) for k, b in unsettled.items()})
    return [found[k].lo if k in found else None for k in range(len(wanted))]


def _for_series(choices: Mapping[int, Column]) -> Column:
    """The expression that belongs to the row's series."""
    chosen = F.lit(None)
    for k, choice in choices.items():
        chosen = F.when(F.col("series") == k, choice).otherwise(chosen)
    return chosen


def _within(values: DataFrame, bins: Mapping[int, Row]) -> DataFrame:
    return values.filter(
        _for_series({k: F.col("v").between(b.lo, b.hi) for k, b in bins.items()})
    )


def _bins(values: DataFrame, bin_of: Column) -> DataFrame:
    """Per series and bin: extent, size, values up to and including it."""
    bins = values.groupBy("series", bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    # The windows run over bins, or over values where these are few.
    running = Window.partitionBy("series").orderBy("bin")
    return bins.withColumns(
        {"upto": F.sum("n").over(running)}
    )


def _locate(bins: DataFrame, ranks: Mapping[int, tuple[int, Column]]) -> dict[int, Row]:
    """For each wanted (series, rank): the bin that holds it and the rank within the bin."""
    each = (
        F.struct(F.lit(k).alias("k"), F.lit(s).alias("of"), rank.cast("long").alias("rank"))
        for k, (s, rank) in ranks.items()
    )
    below = F.col("upto") - F.col("n")
    rows = (
        bins.select("*", F.inline(F.array(*each)))
        .filter((F.col("series") == F.col("of")) & F.col("rank").between(below + 1, F.col("upto")))
        .select("k", "n", "lo", "hi", (F.col("rank") - below).alias("rank"))
        .collect()
    )
    return {row.k: row for row in rows}
