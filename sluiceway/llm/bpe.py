"""Byte-level BPE, encoded by a segment tree over the ranks of adjacent pairs, and decoded.

A piece of text becomes one symbol per byte. The tree's leaves hold the rank of each adjacent
pair, with its place as the lower digits, and every inner node the least of its two children,
so the root is the leftmost pair of the lowest rank. Merging it changes three leaves: its own,
the one to its left, and the one that vanishes; each change climbs the tree once. This goes on
until the root says that no pair can be merged.

Spark runs this over Arrow batches, a text at a time. The vocabulary (a file of fixed size)
is broadcast. Each Python worker remembers some ``MEMO`` short pieces it has encoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how byte-level BPE cuts text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 200_000
MEMO_LENGTH = 48
_CELLS = 1 << 18
_LONG = 512
_ROWS = 256
_NONE = 1 << 62


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary, as byte-level BPE has it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe(dict):
    """A vocabulary with its merges; as a dict, the ids (int32, as bytes) of the pieces met so far."""

    def __init__(self, definition: str):
        super().__init__()
        told = json.loads(definition)
        model, byte = told["model"], byte_characters()
        spelled = {token: bytes(byte[c] for c in token) for token in model["vocab"] if all(c in byte for c in token)}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens") or ()}
        self.spelling = {i: spelled[t] for t, i in model["vocab"].items() if t in spelled}
        self.spelling |= {i: t.encode() for t, i in self.special.items()}
        ids = model["vocab"]
        self.single = np.array([ids[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.products = np.array([ids[left + right] for left, right in merges], np.int32)
        keys = np.array([ids[left] << 32 | ids[right] for left, right in merges], np.int64)
        self.pair_keys, self.pair_ranks = np.unique(keys, return_index=True)
        self.pairs = {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.pair_keys.tolist(), self.pair_ranks.tolist())}
        self.pieces = regex.compile(PIECES)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def __missing__(self, piece: str) -> bytes:
        self.learn([piece])
        return self.pop(piece) if len(piece) > MEMO_LENGTH else self[piece]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces not met so far, those of like length at once."""
        widths: dict[int, list[str]] = {}
        for piece in pieces:
            if piece not in self:
                n = len(piece.encode("utf-8", "surrogatepass"))
                widths.setdefault(max(8, 1 << (n - 1).bit_length()), []).append(piece)
        for width, same in widths.items():
            step = max(1, _CELLS // width)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                spelled = [p.encode("utf-8", "surrogatepass") for p in part]
                if width > _LONG:  # one by one; numpy would do one row's step at a time
                    self.update({p: self.merged_alone(b) for p, b in zip(part, spelled)})
                    continue
                symbols = self.merged(spelled, width)
                live = symbols >= 0
                flat, ends = symbols[live].tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
                self.update({p: flat[i:j] for p, i, j in zip(part, [0, *ends], ends)})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; _NONE where it has none or a symbol is absent."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], _NONE)

    def merged(self, spelled: list[bytes], width: int) -> np.ndarray:
        """Per piece a row of symbols after all merges, -1 where merging left a gap.

        Row by row a segment tree of ``width`` leaves (a power of two); the numpy operations
        carry out the same step for all rows that still have a pair to merge.
        """
        n = len(spelled)
        lengths = np.fromiter(map(len, spelled), np.int64, n)
        places = np.arange(width)
        inside = places < lengths[:, None]
        symbols = np.full((n, width + 1), -1, np.int32)  # the last column stands for "no neighbour"
        symbols[:, :width][inside] = self.single[np.frombuffer(b"".join(spelled), np.uint8)]
        after, before = np.tile(places + 1, (n, 1)), np.tile(places - 1, (n, 1))
        after[places + 1 >= lengths[:, None]] = width
        before[:, 0] = width
        tree = np.full((n, 2 * width), _NONE, np.int64)
        ranks = self.rank(symbols[:, :width], symbols[:, 1:])
        tree[:, width:] = np.where(ranks < _NONE, ranks * width + places, _NONE)
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            right, left = after[rows, gone], before[rows, at]
            symbols[rows, at] = merged = self.products[root // width]
            symbols[rows, gone] = -1
            after[rows, at] = right
            has = right < width
            before[rows[has], right[has]] = at[has]
            self._set(tree, rows, gone, np.full(len(rows), _NONE), width)
            self._set(tree, rows, at, self.rank(merged, symbols[rows, right]), width)
            has = left < width
            r, left, merged = rows[has], left[has], merged[has]
            self._set(tree, r, left, self.rank(symbols[r, left], merged), width)
            rows = rows[tree[rows, 1] < _NONE]
        return symbols[:, :width]

    def merged_alone(self, spelled: bytes) -> bytes:
        """The ids of one long piece; the same tree as a list."""
        symbols = self.single[np.frombuffer(spelled, np.uint8)].tolist()
        n, pairs = len(symbols), self.pairs
        size = 1 << n.bit_length()
        tree = [_NONE] * (2 * size)
        tree[size : size + n - 1] = [
            rank * size + i if (rank := pairs.get(pair)) is not None else _NONE
            for i, pair in enumerate(zip(symbols, symbols[1:]))
        ]
        for at in range(size - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(place: int, pair: tuple[int, int] | None) -> None:
            rank = pairs.get(pair)
            value, at = (_NONE if rank is None else rank * size + place), place + size
            while at and tree[at] != value:
                tree[at] = value
                if at > 1:
                    value = min(value, tree[at ^ 1])
                at >>= 1

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != _NONE:
            at, rank = root % size, root // size
            gone = after[at]
            symbols[at], symbols[gone] = int(self.products[rank]), -1
            right, left = after[gone], before[at]
            after[at] = right
            put(gone, None)
            put(at, (symbols[at], symbols[right]) if right < n else None)
            if right < n:
                before[right] = at
            if left >= 0:
                put(left, (symbols[left], symbols[at]))
        return np.array([x for x in symbols if x >= 0], np.int32).tobytes()

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, rank: np.ndarray, width: int) -> None:
        """Put one leaf of each row and correct the nodes above it."""
        at = place + width
        tree[rows, at] = np.where(rank < _NONE, rank * width + place, _NONE)
        for _ in range(width.bit_length() - 1):
            at >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; special tokens in it are recognised."""
        if not text:
            return np.empty(0, np.int32)
        if self._marked(text):
            parts = self.marks.split(text)
            found = [np.array([self.special[p]], np.int32) if p in self.special else self.encode(p) for p in parts]
            return np.concatenate(found)
        return self._joined(self.pieces.findall(text))

    def _joined(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int32)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; pieces that are new to a run of texts are learnt together."""
        for some in _runs(texts):
            if len(self) > MEMO:
                self.clear()
            cut = [self.pieces.findall(t) if t and not self._marked(t) else None for t in some]
            self.learn({p for c in cut if c for p in c if len(p) <= MEMO_LENGTH})
            for text, c in zip(some, cut, strict=True):
                yield self.encode(text) if c is None else self._joined(c)

    def _marked(self, text: str) -> bool:
        return any(mark in text for mark in self.special)

    def decode(self, ids: Iterable[int] | None) -> str:
        """The text of some ids; bytes that are not UTF-8 become U+FFFD."""
        if ids is None:
            return ""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")


def _runs(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about a million characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size > 1_000_000:
            yield held
            held, size = [], 0
    yield held


_loaded: dict[int, ByteBpe] = {}


def _load(definition) -> ByteBpe:
    """One vocabulary per worker and broadcast, kept between tasks."""
    if definition.id not in _loaded:
        _loaded.clear()
        _loaded[definition.id] = ByteBpe(definition.value)
    return _loaded[definition.id]


class _Shared:
    """A broadcast and a name for it that both sides know."""

    def __init__(self, spark, definition: str):
        self.id = hash(definition)
        self.broadcast = spark.sparkContext.broadcast(definition)

    @property
    def value(self) -> str:
        return self.broadcast.value


def encoded(
    docs: DataFrame, definition: str, *, text: str = "text", ids: str = "ids", again: str | None = None
) -> DataFrame:
    """Every row with ``ids``, an array<int> of its whole text's ids.

    ``again`` names a column for the text that these ids decode to; it spares a second pass.
    ``definition`` is the tokenizer's JSON. A null or empty text has no ids, and decodes to an
    empty one. Rows, also repeated ones, and other columns stay; columns with the names of new
    ones are replaced.
    """
    shared = _Shared(docs.sparkSession, definition)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    new += [T.StructField(again, T.StringType())] if again else []
    kept = [f for f in docs.schema if f.name not in (ids, again)]
    passed = [f.name for f in kept]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(shared)
        for batch in batches:
            for low in range(0, len(batch), _ROWS):
                some = batch.slice(low, _ROWS)
                found = list(model.encode_all(some.column("__text").to_pylist()))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = [some.column(name) for name in passed]
                columns.append(pa.ListArray.from_arrays(ends, np.concatenate(found)))
                if again:
                    columns.append(pa.array([model.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*passed, *(f.name for f in new)])

    given = docs.withColumn("__text", F.col(text)).select(*passed, "__text")
    return given.mapInArrow(encode, T.StructType([*kept, *new]))


def decoded(docs: DataFrame, definition: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Every row with ``text``, what its ids spell; empty for null or no ids.

    An id that the vocabulary lacks is an error.
    """
    shared = _Shared(docs.sparkSession, definition)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(shared)
        for batch in batches:
            yield pd.Series([model.decode(x) for x in batch], dtype=object)

    return docs.withColumn(text, decode(F.col(ids)))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
