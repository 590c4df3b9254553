import math
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import Row

from sluiceway.operators.quantile import exact_quantiles, settled_quantiles

SHARES = [1e-9, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def brute_force(values, p):
    numbers = sorted(v for v in values if v is not None and not math.isnan(v))
    return numbers[max(math.ceil(p * len(numbers)), 1) - 1] if numbers else None


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3)


CASES = {
    "uniform": lambda r: r.uniform(-1000, 1000),
    "heavy tail": lambda r: math.copysign(10 ** r.uniform(-300, 300), r.random() - 0.5),
    "one value holds a third": lambda r: 7.0 if r.random() < 0.34 else r.gauss(7, 1),
    "integers": lambda r: float(r.randint(0, 5)),
    "close together": lambda r: 1e15 + r.randint(0, 900),
    "tiny": lambda r: r.random() * 1e-12,
    "gaps": lambda r: r.choice([None, math.nan, math.inf, -math.inf, -0.5, 3.25, 1e308, -1e308]),
}


@pytest.mark.parametrize("few", [1, 40, 100_000])
@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case, few):
    draw = random.Random(case)
    values = [CASES[case](draw) for _ in range(700)]
    wanted = [("x", p) for p in SHARES]
    assert exact_quantiles(frame(spark, values), wanted, few=few) == [
        brute_force(values, p) for p in SHARES
    ]


def test_many_columns_share_the_passes(spark):
    df = spark.range(1000).selectExpr("id as a", "cast(id * id as double) as b", "null + id as c")
    wanted = [("a", 0.5), ("b", 0.5), ("c", 0.5), ("a", 1.0), ("a", 0.5)]
    for few in (5, 1000):
        assert exact_quantiles(df, wanted, few=few) == [499.0, 499.0**2, None, 999.0, 499.0]


def test_nothing_to_rank(spark):
    assert exact_quantiles(frame(spark, []), [("x", 0.5)]) == [None]
    assert exact_quantiles(frame(spark, [None, math.nan]), [("x", 0.5)]) == [None]


def test_share_must_be_positive(spark):
    with pytest.raises(ValueError):
        exact_quantiles(frame(spark, [1.0]), [("x", 0.0)])


def test_brackets_that_miss_and_hot_values_are_settled(spark):
    # Two thirds of the values lie close together, a third of all are the same.
    df = spark.range(900).selectExpr(
        "case when id % 3 = 0 then 100.0D when id % 3 = 1 then 100 + id / 1e4 else id end as x"
    )
    values = [row.x for row in df.collect()]
    wanted = [("x", p) for p in (0.01, 0.5, 0.99, 1.0)]
    for few in (1, 5, 100_000):
        assert exact_quantiles(df, wanted, few=few) == [brute_force(values, p) for _, p in wanted]
    wrong = [Row(n=900, lo=5.0, hi=6.0), Row(n=900, lo=800.0, hi=899.0)]
    for few in (1, 100_000):
        found = settled_quantiles(df, wanted[1:3], wrong, few=few)
        assert found == [brute_force(values, 0.5), brute_force(values, 0.99)]


def test_nothing_is_left_in_the_checkpoint_folder(spark, tmp_path):
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir() or str(tmp_path)).path)
    before = sorted(folder.rglob("*"))
    exact_quantiles(spark.range(5000).selectExpr("cast(id as double) x"), [("x", 0.5)], few=2)
    assert sorted(folder.rglob("*")) == before
