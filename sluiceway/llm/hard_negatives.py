"""Hard negatives by a vertical scan: dimension after dimension, with bounds on what is to come.

Rows are put in order of vector length and label and cut into blocks of ``BLOCK``; anchors, in the
same order, into groups of ``GROUP``. A block is one row, its components stored by dimension, so that a
dimension is read as one array. A task holds one block and one group, and for each anchor

1. reads dimensions in descending magnitude of the anchor's own components, adding to the score
   of each candidate that is left;
2. knows from each dimension's least and greatest value in the block what the dimensions that
   remain can add at least and at most;
3. drops a candidate from the bitmap when these bounds rule it out, and reads the dimensions that
   remain for the others only, until their scores are exact.

This is done twice. For positives, a group meets the blocks that hold its labels, and a candidate is
out when ``positives`` others are surely above it. Tiles give out that many rows an anchor; the
first of them over all tiles are the anchor's positives, which give the windows of scores that its
negatives lie in. For negatives, a group meets all blocks of its vector length, and a candidate is out when
it lies in no window, or is in each of those that it may lie in surely below ``negatives`` others.
A tile gives out that many rows a window, and one shuffle by anchor and positive ranks them.

Each anchor has to be held against each row of another label, so tiles, and the rows that they are
made of, grow with anchors times rows; a block is shipped once per group, in 2 bytes a number where
they fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.tables import numbered, saved

POSITIVES = 5
NEGATIVES = 10
LEAST, MOST = 30, 90  # per cent of the positive's score
SCALE = 256
BLOCK = 4096
GROUP = 1024
_STEP = 8  # dimensions between two looks at the bounds
_INT = np.iinfo(np.int64)
_FAR = 10**37  # what a decimal holds
_PACKED = "place long, size int, kind string, rows binary, ids binary, labels binary, numbers binary"


def whole(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(SCALE * x) of equally long vectors, one below the other; Python's numbers where int64 is too small."""
    x = np.stack(vectors).astype(float)
    if not x.size or np.abs(x).max() < 2.0**52 / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [[math.floor(v * SCALE) if abs(v) < 2.0**52 else int(v) * SCALE for v in row] for row in x.tolist()]
    return np.array(exact, dtype=object)


def _pack(numbers: np.ndarray) -> tuple[str, bytes]:
    """By dimension, in the smallest of the types that holds them."""
    if numbers.dtype == object:
        return "text", "\n".join(map(str, numbers.T.ravel())).encode()
    most = int(np.abs(numbers).max(initial=0))
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits)
    return kind, numbers.T.astype(kind).tobytes()


def _unpack(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, labels, and components by dimension."""
    rows, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
    if row["kind"] == "text":
        numbers = np.array([int(x) for x in row["numbers"].decode().split()], dtype=object)
    else:
        numbers = np.frombuffer(row["numbers"], row["kind"]).astype(np.int64)
    return rows, ids, labels, numbers.reshape(row["size"], len(ids))


class Scan:
    """The candidates of a block, for one anchor after another."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.least, self.greatest = numbers.min(axis=1), numbers.max(axis=1)

    def safe_for(self, anchors: np.ndarray) -> bool:
        """Whether scores with these anchors, and a hundred times as much, fit in int64."""
        most = [int(np.abs(x).max(initial=0)) for x in (self.numbers, anchors)]
        return most[0] * most[1] * max(1, len(self.numbers)) < (1 << 63) // 1000

    def scores(self, anchor: np.ndarray, left: np.ndarray, rules) -> tuple[np.ndarray, np.ndarray]:
        """The candidates ``left`` that ``rules`` leaves in, and their exact scores.

        ``rules(low, high, left)`` gets bounds on the scores and says which candidates stay.
        """
        order = np.argsort([-abs(x) for x in anchor.tolist()], kind="stable")
        a = anchor[order]
        one, two = a * self.least[order], a * self.greatest[order]
        rest_low = np.append(np.cumsum(np.minimum(one, two)[::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(np.maximum(one, two)[::-1])[::-1], 0)
        score = np.zeros(len(left), self.numbers.dtype)
        for at in range(0, len(a), _STEP):
            if not len(left):
                break
            dimensions = order[at : at + _STEP]
            score = score + a[at : at + _STEP] @ self.numbers[np.ix_(dimensions, left)]
            done = min(at + _STEP, len(a))
            stay = rules(score + rest_low[done], score + rest_high[done], left)
            left, score = left[stay], score[stay]
        return left, score


def _nth(values: np.ndarray, n: int):
    """The n-th greatest, or None if there are fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else None


def nearest_positives(scan: Scan, ids: np.ndarray, anchor: np.ndarray, left: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The first n of the candidates ``left``: score and id."""

    def rules(low: np.ndarray, high: np.ndarray, left: np.ndarray) -> np.ndarray:
        bar = _nth(low, n)
        return np.ones(len(left), bool) if bar is None else high >= bar

    left, score = scan.scores(anchor, left, rules)
    return _first(score, ids[left], n)


def windowed(
    scan: Scan, ids: np.ndarray, anchor: np.ndarray, left: np.ndarray, positives: list[int], n: int, least: int, most: int
) -> dict[int, list[tuple[int, int]]]:
    """For each different score of a positive, the first n candidates in its window: score and id."""
    windows = sorted({p for p in positives if least * p <= most * p}, reverse=True)

    def rules(low: np.ndarray, high: np.ndarray, left: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(left), bool)
        for p in windows:
            may = (100 * high >= least * p) & (100 * low <= most * p)
            bar = _nth(low[(100 * low >= least * p) & (100 * high <= most * p)], n)
            stay |= may if bar is None else may & (high >= bar)
        return stay

    if not windows:
        return {}
    left, score = scan.scores(anchor, left, rules)
    inside = {p: (100 * score >= least * p) & (100 * score <= most * p) for p in windows}
    return {p: _first(score[x], ids[left[x]], n) for p, x in inside.items()}


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, -score)) if score.dtype != object else sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))
    return [(min(max(int(score[i]), -_FAR), _FAR), int(ids[i])) for i in order[:n]]


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each ``place`` and vector length, with its rows by dimension."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        kind, numbers = _pack(whole(f["vector"].to_list()))
        held = {c: f[n].to_numpy(np.int64).tobytes() for c, n in (("rows", "row"), ("ids", "vec_id"), ("labels", "label"))}
        return pd.DataFrame([{"place": f["place"].iloc[0], "size": f["size"].iloc[0], "kind": kind, **held, "numbers": numbers}])

    return rows.select("place", "size", "row", "vec_id", "label", "vector").groupBy("place", "size").applyInPandas(pack, _PACKED)


def _met(blocks: DataFrame, groups: DataFrame, compare, schema: str) -> DataFrame:
    """What ``compare`` finds in each pair of a block and a group; both name the first and last they meet."""
    every = F.explode(F.sequence("first", "last"))
    shared = [c for c in blocks.columns if c not in ("place", "first", "last")]
    more = [c for c in groups.columns if c not in (*shared, "place", "first", "last")]
    left = blocks.select(F.col("place").alias("block"), every.alias("group"), F.lit(False).alias("asks"), *shared)
    right = groups.select(every.alias("block"), F.col("place").alias("group"), F.lit(True).alias("asks"), *shared, *more)

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, block in f[~f["asks"]].iterrows():
            for _, group in f[f["asks"]].iterrows():
                if block["size"] == group["size"]:
                    found += compare(block, group)
        return pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(", ")])

    return left.unionByName(right, allowMissingColumns=True).groupBy("block", "group").applyInPandas(tile, schema)


def _meeting(places: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Each place with the first and last of the other places that share a value of ``by`` with it.

    Places are in order of ``by``, so all between these share one too.
    """
    spans = others.groupBy(*by).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return (
        places.select("place", *by).distinct().join(spans, by).groupBy("place")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block: int = BLOCK,
    group: int = GROUP,
    vector: str = "embedding",
) -> DataFrame:
    """Rows anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and an array of numbers; ``is_anchor`` says which rows are anchors. A
    component x counts as floor(256 x), x in double precision; a score is the inner product with
    the anchor, a whole number. Higher scores come first, ties by the smaller vec_id. An anchor's
    positives are the first ``positives`` other rows of its label. Its negatives for one of them are the
    first ``negatives`` rows of another label whose score is at least ``least`` and at most ``most`` per
    cent of the positive's.

    Rows take no part whose vec_id, label or vector is null, or whose vector has a component that is
    null or not finite. Vectors meet those of their own length; empty ones have scores of 0. Rows that
    repeat one another, or a vec_id, are rows of their own, so a copy of an anchor can be its
    positive, and each is answered. Scores beyond 64 bits are shown as the nearest long, and those beyond
    10^37 count as that. An anchor without positives, or a positive without negatives, gives no row, and
    an empty table gives none. Other columns are ignored.
    """
    numbers = F.col(vector).cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound).select(
        F.size(numbers).alias("size"),
        F.col("label").cast("long").alias("label"),
        F.col("vec_id").cast("long").alias("vec_id"),
        numbers.alias("vector"),
        is_anchor.alias("asks"),
    )
    # Sorting by id spreads anchors over the groups of their label, and makes a row's number firm.
    by = ["size", "label"]
    rows = saved(numbered(usable, [F.col(c) for c in (*by, "vec_id")]).withColumnRenamed("number", "row"), "rows")
    asking = saved(numbered(rows.filter("asks"), [F.col("row")]), "anchors")
    rows, asking = rows.withColumn("place", F.expr(f"row div {block}")), asking.withColumn("place", F.expr(f"number div {group}"))
    blocks, groups = saved(_packed(rows), "blocks"), saved(_packed(asking), "groups")

    def reaching(by: list[str]) -> tuple[DataFrame, DataFrame]:
        return (
            blocks.join(_meeting(rows, asking, by), "place"),
            groups.join(_meeting(asking, rows, by), "place"),
        )

    def anchored(block_row: pd.Series, group_row: pd.Series, same: bool) -> Iterator[tuple]:
        """Each anchor with the candidates of its own label, or of the others."""
        numbers, ids, labels, x = _unpack(block_row)
        anchors, anchor_ids, anchor_labels, y = _unpack(group_row)
        scan = Scan(x)
        if not scan.safe_for(y):
            scan, y = Scan(x.astype(object)), y.astype(object)
        for i in range(len(anchors)):
            alike = labels == anchor_labels[i]
            left = np.flatnonzero(alike & (numbers != anchors[i]) if same else ~alike)
            if len(left):
                yield i, int(anchors[i]), int(anchor_ids[i]), scan, ids, y[:, i], left

    def near(block_row: pd.Series, group_row: pd.Series) -> list[tuple]:
        out = []
        for _, row, anchor_id, scan, ids, anchor, left in anchored(block_row, group_row, True):
            out += [(row, anchor_id, vec, str(score)) for score, vec in nearest_positives(scan, ids, anchor, left, positives)]
        return out

    found = _met(*reaching(by), near, "row long, anchor_id long, positive_id long, score string")
    score = F.col("score").cast("decimal(38,0)")
    first = Window.partitionBy("row").orderBy(score.desc(), "positive_id")
    found = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives)
    found = saved(found, "positives")
    held = found.join(asking.select("row", "place"), "row").groupBy("place").agg(
        F.collect_list(F.struct("row", "n", "positive_id", "score")).alias("positives")
    )

    def apart(block_row: pd.Series, group_row: pd.Series) -> list[tuple]:
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for p in group_row["positives"]:
            wanted.setdefault(p["row"], []).append((p["n"], p["positive_id"], int(p["score"])))
        out = []
        for _, row, anchor_id, scan, ids, anchor, left in anchored(block_row, group_row, False):
            mine = wanted.get(row, [])
            inside = windowed(scan, ids, anchor, left, [s for *_, s in mine], negatives, least, most)
            for n, positive_id, s in mine:
                out += [(row, n, anchor_id, positive_id, str(s), vec, str(score)) for score, vec in inside.get(s, ())]
        return out

    blocks, groups = reaching(["size"])
    tiles = _met(
        blocks, groups.join(held, "place"), apart,
        "row long, n int, anchor_id long, positive_id long, positive string, negative_id long, score string",
    )
    first = Window.partitionBy("row", "n").orderBy(score.desc(), "negative_id")
    ranked = tiles.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)

    def shown(c: str) -> Column:
        low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in (_INT.min, _INT.max))
        return F.greatest(low, F.least(high, F.col(c).cast("decimal(38,0)"))).cast("long")

    return ranked.select(
        "anchor_id",
        "positive_id",
        "rank",
        "negative_id",
        shown("positive").alias("positive_score"),
        shown("score").alias("negative_score"),
    )
