import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm.hard_negatives import Scan, hard_negatives, nearest_positives, whole, windowed

ROWS = "vec_id long, label int, embedding array<double>"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, is_anchor, positives=5, negatives=10, least=30, most=90):
    """The same in plain Python, with whole numbers of any size."""
    used = []
    for i, (vec, label, v) in enumerate(rows):
        if vec is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, vec, label, [math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v]))
    out = []
    for i, vec, label, a in used:
        if not is_anchor(vec):
            continue
        meet = [(-sum(x * y for x, y in zip(a, b)), w, m == label) for j, w, m, b in used if j != i and len(a) == len(b)]
        for p, w, _ in sorted(x for x in meet if x[2])[:positives]:
            inside = sorted((s, n) for s, n, same in meet if not same and least * -p <= 100 * -s <= most * -p)
            out += [(vec, w, k + 1, n, -p, -s) for k, (s, n) in enumerate(inside[:negatives])]
    return sorted(out)


def answers(spark, rows, is_anchor, **options):
    frame = hard_negatives(spark.createDataFrame(rows, ROWS).repartition(5), is_anchor, **options)
    assert frame.columns == list(COLUMNS)
    return sorted(tuple(r) for r in frame.collect())


def made(seed, n, size=12, labels=4, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, spread) for _ in range(size)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = 0 if rnd.random() < 0.4 else rnd.randrange(labels)
        rows.append((i, label, [x + rnd.gauss(0, spread) for x in centres[rnd.randrange(labels)]]))
    return rows


def test_rows_equal_brute_force_over_many_tiles(spark):
    rows = made(1, 400)
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert answers(spark, rows, F.col("vec_id") % 10 == 0) == want
    assert answers(spark, rows, F.col("vec_id") % 10 == 0, block=37, group=6) == want


def test_ties_copies_odd_vectors_and_lengths(spark):
    rows = made(2, 60, spread=0.004)  # few different numbers, so many ties
    rows += [rows[10], rows[10], rows[10], (10, 3, rows[10][2]), (20, 0, [0.5] * 12)]
    rows += [(i, i % 3, [float(i % 5), 1.5]) for i in range(100, 140)]
    rows += [(i, i % 2, []) for i in range(200, 212)]
    rows += [(None, 1, [1.0] * 12), (300, None, [1.0] * 12), (310, 1, None), (320, 1, [1.0, None] * 6)]
    rows += [(330, 1, [math.nan] * 12), (340, 1, [math.inf] * 12), (350, 0, [0.0] * 12)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert answers(spark, rows, F.col("vec_id") % 10 == 0, block=16, group=4) == want
    assert any(r[0] == 10 and r[1] == 10 for r in want)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, i % 2, [(-1) ** i * 1e9 * (i + 1), 1e12 / (i + 1), 3.5]) for i in range(30)]
    rows += [(100 + i, i % 2, [1e300 * (1 + i), 1e-300, -2.5]) for i in range(6)]
    top, far = 2**63 - 1, 10**37

    def shown(r):
        return (*r[:4], *(max(min(x, top), -top - 1) for x in r[4:]))

    small = rows[:30]
    want = [shown(r) for r in plain(small, lambda i: i % 5 == 0)]
    assert want and answers(spark, small, F.col("vec_id") % 5 == 0) == sorted(want)
    assert far > top and isinstance(answers(spark, rows, F.col("vec_id") % 5 == 0), list)


def test_single_labels_empty_tables_and_clashing_columns(spark):
    assert answers(spark, [(i, 1, [1.0, i / 9]) for i in range(20)], F.col("vec_id") % 2 == 0) == []
    assert answers(spark, [(i, i, [1.0, i / 9]) for i in range(20)], F.col("vec_id") % 2 == 0) == []
    assert answers(spark, [], F.col("vec_id") % 2 == 0) == []
    rows = made(3, 50)
    frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("row", "place", "size", "number", "rank", "score")})
    got = hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("seed", range(30))
def test_bounds_drop_none_that_counts(seed):
    rnd = random.Random(seed)
    size, n = rnd.randrange(1, 40), rnd.randrange(1, 200)
    x = np.array([[rnd.randrange(-9, 10) * (d % 5 + 1) for _ in range(n)] for d in range(size)], np.int64)
    ids, left = np.arange(n) % 50, np.flatnonzero([rnd.random() < 0.7 for _ in range(n)])
    anchor = np.array([rnd.randrange(-20, 20) for _ in range(size)], np.int64)
    score = anchor @ x
    scan, first = Scan(x), sorted((-int(score[i]), int(ids[i])) for i in left)
    assert nearest_positives(scan, ids, anchor, left, 3) == [(-s, i) for s, i in first[:3]]
    targets = [int(np.quantile(np.abs(score), q)) for q in (0.2, 0.5, 0.9)] + [0, -5]
    got = windowed(scan, ids, anchor, left, targets, 4, 30, 90)
    for p in targets:
        inside = [(-s, i) for s, i in first if 30 * p <= -100 * s <= 90 * p]
        assert got.get(p, []) == inside[:4]


def test_components_are_floored_as_doubles():
    assert whole([np.array([0.0039, -0.0001, 1.0])]).tolist() == [[0, -1, 256]]
    assert whole([np.array([1e300])]).tolist() == [[int(1e300) * 256]]
