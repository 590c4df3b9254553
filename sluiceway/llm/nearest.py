"""Nearest neighbours by a block matrix join over int8 vectors, exact in the end.

Rows are numbered, so that those that share a vec_id are told apart. Candidates and queries are
dealt into blocks by hash, and every block of queries meets every block of candidates in a tile,
which is all that a task holds at a time. Numbers are shipped as they are given, in 4 bytes or
8; blocks are large, since each candidate is shipped once for each block of queries. A tile is
worked off in steps of ``step`` queries and as many candidates, in each of which

1. vectors become int8 numbers times the block's scale, and each keeps the length of what
   rounding took from it;
2. one matrix product of the int8 numbers gives all distances between rounded vectors. A true
   distance differs from it by no more than the two lengths;
3. the k-th least upper bound of a query limits what can be among its k nearest: candidates
   whose lower bound is above it are out;
4. for those left, the distance is computed from the given vectors in double precision.

A step gives out at most k rows per query. Heaps of k merge these, first within each task and
then, after one shuffle by query, over all tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.tables import saved

NEAREST = 10
BLOCK = 4096
STEP = 1024
_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Vectors as int8 (held as float32, for the product), their scale, and what is lost."""
    scale = float(np.abs(vectors).max()) / 127 or 1.0
    near = np.rint(vectors / scale)
    return near.astype(np.float32), scale, np.linalg.norm(vectors - near * scale, axis=1)


def tile(
    query_rows: np.ndarray,
    queries: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    nearest: int,
) -> list[tuple[int, int, float]]:
    """Each query's nearest: places of query and candidate, distance; ties to the smaller id, then row."""
    q, q_scale, q_lost = rounded(queries)
    c, c_scale, c_lost = rounded(vectors)
    # Sums of products of int8 are whole numbers; float32 holds them up to 2 ** 24.
    step = max(1, (1 << 24) // 127**2)
    product = sum((q[:, k : k + step] @ c[:, k : k + step].T).astype(float) for k in range(0, q.shape[1], step))
    square = ((q.astype(float) * q_scale) ** 2).sum(axis=1)[:, None] + ((c.astype(float) * c_scale) ** 2).sum(axis=1)
    between = np.sqrt(np.maximum(square - 2 * q_scale * c_scale * product, 0.0))
    slack = q_lost[:, None] + c_lost + 1e-6 * np.sqrt(square)  # the last for the rounding of doubles
    own = query_rows[:, None] == rows
    upper = np.where(own, np.inf, between + slack)
    k = min(nearest, len(ids))
    limit = np.partition(upper, k - 1, axis=1)[:, k - 1]
    left = ~own & (between - slack <= limit[:, None])
    out = []
    for i in range(len(query_rows)):
        at = np.flatnonzero(left[i])
        square_sums = np.cumsum((vectors[at] - queries[i]) ** 2, axis=1)  # added up in order
        score = np.sqrt(square_sums[:, -1])
        best = np.lexsort((rows[at], ids[at], score))[:nearest]
        out += [(i, j, s) for j, s in zip(at[best], score[best], strict=True)]
    return out


def _merged(found: DataFrame, nearest: int) -> DataFrame:
    """Each query's nearest rows of each partition, by a heap per query."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for f in frames:
            for query_row, query, row, vec, score in zip(*(f[c].tolist() for c in names), strict=True):
                heap = heaps.setdefault((query_row, query), [])
                entry = -score, -vec, -row
                if len(heap) < nearest:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        rows = [(*query, -row, -vec, -score) for query, heap in heaps.items() for score, vec, row in heap]
        yield pd.DataFrame(rows, columns=names)

    names = found.columns
    return found.mapInPandas(merge, _FOUND)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    *,
    nearest: int = NEAREST,
    block: int = BLOCK,
    step: int = STEP,
    vector: str = "embedding",
) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score, query_row: each query's nearest of all other vectors.

    ``vectors`` has vec_id and an array of numbers; ``is_query`` says which are queries too.
    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id.
    Rows take no part whose vec_id or vector is null, empty, zero, or holds a null or a number
    that is not finite; vectors meet those of their own length only. Rows that repeat a vec_id
    are each a candidate and, with a query's id, each a query, told apart by ``query_row``; such a
    row meets the others of its id, and only itself not. A query with fewer candidates gets
    all. An empty table gives no rows; other columns are ignored.
    """
    kind = vectors.schema[vector].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.ByteType, T.ShortType))
    numbers = F.col(vector).cast("array<float>" if narrow else "array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(numbers, lambda x: x != 0)
    usable = vectors.filter(F.col("vec_id").isNotNull() & sound & some).select(
        F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("vector"), is_query.alias("is_query")
    )
    # Numbered once and written, so that a row keeps its number when a task runs again.
    usable = saved(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = usable.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, query_blocks = (max(1, -(-counts[c] // block)) for c in ("n", "q"))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    candidates = usable.select(
        "row", "vec_id", "vector", F.lit(False).alias("asks"), dealt(blocks).alias("block")
    ).withColumn("queries", every(query_blocks))
    queries = usable.filter("is_query").select(
        "row", "vec_id", "vector", F.lit(True).alias("asks"), dealt(query_blocks).alias("queries")
    )
    queries = queries.withColumn("block", every(blocks)).select(candidates.columns)

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        parts = []
        asks = f["asks"].to_numpy(bool)
        size = f["vector"].map(len).to_numpy()
        for n in np.unique(size[asks]):
            all_asking, all_held = f[asks & (size == n)], f[~asks & (size == n)]
            for q_at in range(0, len(all_asking), step):
                q = all_asking.iloc[q_at : q_at + step]
                asking = np.stack(q["vector"].to_list()).astype(float)
                for c_at in range(0, len(all_held), step):
                    c = all_held.iloc[c_at : c_at + step]
                    held = np.stack(c["vector"].to_list()).astype(float)
                    rows, ids = c["row"].to_numpy(), c["vec_id"].to_numpy()
                    best = tile(q["row"].to_numpy(), asking, rows, ids, held, nearest)
                    i, j = (np.array([b[k] for b in best], int) for k in (0, 1))
                    score = np.array([b[2] for b in best], float)
                    found = q["row"].to_numpy()[i], q["vec_id"].to_numpy()[i], rows[j], ids[j], score
                    parts.append(pd.DataFrame(dict(zip(names, found, strict=True))))
        return pd.concat(parts) if parts else pd.DataFrame([], columns=names)

    names = ["query_row", "query_id", "row", "vec_id", "score"]
    found = candidates.unionByName(queries).groupBy("block", "queries").applyInPandas(compare, _FOUND)
    best = _merged(_merged(found, nearest).repartition("query_row"), nearest)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score", "query_row")
