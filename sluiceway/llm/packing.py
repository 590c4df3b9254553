"""Pack tokenized documents into fixed windows by non-negative least squares.

1. Every text is tokenized once, ended by id 0, and cut into whole windows and a rest. Only
   one small row per piece (its place, length and checksum) goes further.
2. The lengths are counted: a histogram of at most ``window`` numbers, whatever the input.
3. On the driver, all combinations of two or three lengths that fill a window are the columns
   of a matrix A; least squares ||A x - histogram|| over x >= 0, solved by coordinate descent,
   says how often to use each. The counts are rounded and held to what is there.
4. What is left is packed greedily, longest first, a pattern as often as its lengths allow.
5. The n-th piece of a length takes the n-th slot of that length. Pieces are numbered in
   buckets by hash, so a length with most of the pieces is no one task's work.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.bpe import PIECES, byte_characters
from sluiceway.llm.tables import saved

WINDOW = 1024
END = 0
DEPTH = 3
SWEEPS = 8
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 256
_LONG = 200_000


class Tokenizer:
    """Ids as the tokenizers library has them, by the faster of two libraries.

    Both give the same ids. The faster one has no bound on its search in very long runs of one
    kind, so long texts go to the other, which is loaded when the first of them comes.
    """

    def __init__(self, definition: str):
        import tiktoken

        self.definition = definition
        told, byte = json.loads(definition), byte_characters()
        special = {t["content"]: t["id"] for t in told.get("added_tokens") or ()}
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in told["model"]["vocab"].items()
            if i not in special.values() and all(c in byte for c in token)
        }
        self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer as Slow

        told = json.loads(self.definition) | {"truncation": None, "padding": None}
        return Slow.from_str(json.dumps(told))

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) > _LONG:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


_loaded: dict[int, Tokenizer] = {}


def cut(docs: DataFrame, definition: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens.

    A null text is an empty one: a single piece that holds the end. No rows for no documents;
    repeated rows are cut each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    name = hash(definition)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = Tokenizer(shared.value)
        tokenizer = _loaded[name]
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"], strict=True):
                ids = np.array([*tokenizer.ids(text), END], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"], dtype=object)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of two to ``depth`` of the lengths that add up to the window."""
    present = set(lengths.tolist())
    out = []
    for n in range(2, depth + 1):
        for head in combinations_with_replacement(sorted(present), n - 1):
            last = window - sum(head)
            if last >= head[-1] and last in present:
                out.append((*head, last))
    return out


def least_squares(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS) -> list[float]:
    """x >= 0 that makes the histogram of x times each column nearest to the given one."""
    rest = histogram.astype(float).tolist()
    x = [0.0] * len(columns)
    norms = [sum(c.count(v) for v in c) for c in columns]  # squared: a length used k times adds k * k
    for _ in range(sweeps):
        for j, column in enumerate(columns):
            step = 0.0
            for v in column:
                step += rest[v]
            step /= norms[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for v in column:
                    rest[v] -= step
    return x


def patterns(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """What to put together and how often, so that every piece is used exactly once."""
    left = histogram.astype(np.int64).copy()
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    columns = combinations(np.flatnonzero(left), window)
    x = least_squares(columns, left)
    for j in sorted(np.flatnonzero(np.array(x) >= 0.5).tolist(), key=lambda j: (-x[j], j)):
        times = min(round(x[j]), *(int(left[v]) // columns[j].count(v) for v in columns[j]))
        if times > 0:
            out.append((columns[j], times))
            for v in columns[j]:
                left[v] -= times
    while left.any():
        room, pattern = window, []
        while room and (there := np.flatnonzero(left[: room + 1])).size:
            v = int(there[-1])
            n = min(room // v, int(left[v]))
            pattern.append((v, n))
            left[v] -= n
            room -= v * n
        more = min(int(left[v]) // n for v, n in pattern)
        for v, n in pattern:
            left[v] -= n * more
        out.append((tuple(v for v, n in pattern for _ in range(n)), 1 + more))
    return out


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows of length, first piece of that length, first sequence, offset; sorted."""
    rows, used, sequence = [], {}, 0
    for pattern, times in chosen:
        offset = 0
        for v in pattern:
            rows.append((v, used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + times
            offset += v
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(pieces: DataFrame, *, key: tuple[str, ...] = ("doc_id", "start"), window: int = WINDOW) -> DataFrame:
    """Every row of ``pieces`` with sequence_id and offset.

    Rows have a ``length`` from 1 to ``window``; those that agree in ``key`` and length are
    interchangeable. Sequences are numbered from 0 without gaps, and so are their tokens. An
    empty table gives no rows; other columns stay.
    """
    spark = pieces.sparkSession
    count = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``window`` rows
        if length is None or not 1 <= length <= window:
            raise ValueError(f"a piece has length {length}, not 1 to {window}")
        count[length] = n
    table = slots(patterns(count, window))
    # At most the number of combinations and of greedy patterns, which the window bounds.
    shared = spark.sparkContext.broadcast(table)
    buckets = max(LEAST_BUCKETS, int(count.sum()) // BUCKET_ROWS)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        table = shared.value
        place = (table[:, 0] << 44) + table[:, 1]
        row = np.searchsorted(place, (length.to_numpy(np.int64) << 44) + number.to_numpy(np.int64), "right") - 1
        return pd.DataFrame(
            {"sequence_id": table[row, 2] + number.to_numpy(np.int64) - table[row, 1], "offset": table[row, 3]}
        )

    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    numbered = pieces.withColumn("__bucket", bucket).repartition("__bucket")
    within = F.row_number().over(Window.partitionBy("__bucket", "length").orderBy(*key))
    before = F.sum("__n").over(
        Window.partitionBy("__length").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        pieces.groupBy(bucket.alias("__of"), F.col("length").alias("__length"))
        .agg(F.count("*").alias("__n"))
        .select("__of", "__length", F.coalesce(before, F.lit(0)).alias("__before"))
    )
    joined = numbered.withColumn("__within", within - 1).join(
        sizes, (F.col("__bucket") == F.col("__of")) & (F.col("length") == F.col("__length"))
    )
    return joined.withColumn("__slot", slot("length", F.col("__before") + F.col("__within"))).select(
        *pieces.columns, "__slot.sequence_id", "__slot.offset"
    )


def pack(docs: DataFrame, definition: str, window: int = WINDOW) -> DataFrame:
    """Tokenize, cut and pack whole documents: the columns of ``cut`` and ``packed``."""
    return packed(saved(cut(docs, definition, window), "pieces"), window=window)
