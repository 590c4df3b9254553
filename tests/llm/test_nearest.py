import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm.nearest import nearest_neighbours, rounded, tile

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, queries, nearest):
    out = []
    for q in queries:
        a = np.array(vectors[q], np.float32).astype(float)
        scored = sorted(
            (float(np.sqrt(np.cumsum((np.array(v, np.float32).astype(float) - a) ** 2)[-1])), i)
            for i, v in vectors.items()
            if i != q and len(v) == len(a)
        )
        out += [(q, k + 1, i, s) for k, (s, i) in enumerate(scored[:nearest])]
    return out


@pytest.mark.parametrize("block, step", [(7, 7), (50, 9), (1024, 100), (1024, 1024)])
def test_equals_brute_force_with_ties_and_outliers(spark, block, step):
    rnd = random.Random(2)
    vectors = {i: [rnd.gauss(0, 1) for _ in range(16)] for i in range(180)}
    vectors |= {200 + i: vectors[3] for i in range(40)}  # a hot vector
    vectors |= {300: [1e6] * 16, 301: [1e-6] * 16, 302: [1.0] * 5, 310: [2.0] * 5}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    odd = [(400, None), (410, []), (420, [0.0] * 16), (430, [float("nan")] * 16), (440, [1.0, None]), (450, [float("inf")] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"block": F.lit(1), "vector": F.lit(2), "asks": F.lit(3)})
    got = nearest_neighbours(frame.repartition(5), F.col("vec_id") % 10 == 0, block=block, step=step).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute(vectors, sorted(i for i in vectors if i % 10 == 0), 10)


def test_few_candidates_repeated_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [0.5, 2.0]), (2, [3.0, 2.0]), (1, [9.0, 2.0])]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)]
    assert found == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, 2.0), (0, 4, 1, 8.0)]
    # Each row of a repeated query's id asks, and meets the others.
    got = nearest_neighbours(spark.createDataFrame(rows[1:], SCHEMA), F.col("vec_id") == 1, nearest=1, block=2)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 4)) for r in got.collect()) == [
        (1, 1, 1, 0.7071), (1, 1, 1, 0.7071), (1, 1, 2, 6.0)
    ]
    assert got.select("query_row").distinct().count() == 3
    # Whole rows that repeat are candidates each.
    twice = nearest_neighbours(spark.createDataFrame(rows[:2] + rows[1:2] * 3, SCHEMA), F.col("vec_id") == 0, nearest=3)
    assert [(r.vec_id, r.score) for r in twice.collect()] == [(1, 0.5)] * 3
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    assert nearest_neighbours(spark.createDataFrame(rows[:1], SCHEMA), F.lit(True)).collect() == []
    assert nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect() == []


def test_bounds_hold_and_recall_is_whole():
    rnd = np.random.default_rng(4)
    queries, vectors = rnd.normal(size=(20, 700)), rnd.normal(size=(300, 700)) * rnd.gamma(1, 2, (300, 1))
    q, scale, lost = rounded(queries)
    assert np.abs(q).max() <= 127 and np.allclose(np.linalg.norm(queries - q * scale, axis=1), lost)
    got = tile(np.arange(1000, 1020), queries, np.arange(300), np.arange(300), vectors, 10)
    for i in range(20):
        exact = np.argsort(np.linalg.norm(vectors - queries[i], axis=1))[:10]
        assert [v for query, v, _ in got if query == i] == exact.tolist()
