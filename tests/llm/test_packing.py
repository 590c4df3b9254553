import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm.packing import combinations, least_squares, pack, packed, patterns
from sluiceway.llm.queries import tokenizer
from tests.llm.helpers import DOCS, ODD, documents, prose

tokenizers = pytest.importorskip("tokenizers")


def test_every_id_is_in_one_place(spark):
    reference = tokenizers.Tokenizer.from_str(tokenizer())
    texts = [*ODD, "a<|endoftext|>b", "z" * 250_000, *(prose(i, 20 + 13 * i) for i in range(60)), *["copy me " * 40] * 50]
    want = {i: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    docs = documents(spark, texts).withColumns({"length": F.lit(1), "__bucket": F.lit(2)}).repartition(4)
    rows = pack(docs, tokenizer()).collect()
    for doc, ids in want.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sorted(sequences) == list(range(len(sequences))) and max(sequences.values()) <= 1024
    assert sum(sequences.values()) / (1024 * len(sequences)) > 0.98


def test_patterns_use_each_piece_once_and_fill_windows():
    rnd = random.Random(5)
    for lengths in ([], [1024] * 9, [513] * 20, [7] * 1000, [rnd.randrange(1, 1025) for _ in range(20000)]):
        histogram = np.bincount(lengths, minlength=1025)
        used = np.zeros(1025, int)
        for pattern, times in patterns(histogram):
            assert sum(pattern) <= 1024 and times > 0
            for v in pattern:
                used[v] += times
        assert (used == histogram).all()


def test_least_squares_against_a_dense_solution():
    columns = combinations(np.array([2, 3, 5, 4, 6]), 10)
    a = np.zeros((11, len(columns)))
    for j, c in enumerate(columns):
        for v in c:
            a[v, j] += 1
    h = a @ np.arange(1, len(columns) + 1)
    x = least_squares(columns, h, sweeps=2000)
    assert np.allclose(a @ x, h, atol=1e-3) and min(x) >= 0


def test_empty_table_null_ids_repeated_rows_and_wrong_lengths(spark):
    assert pack(spark.createDataFrame([], DOCS), tokenizer()).collect() == []
    rows = [(None, "a b", None, None, None)] * 3 + [(1, "a b", None, None, None)] * 2
    out = pack(spark.createDataFrame(rows, DOCS), tokenizer()).collect()
    assert len(out) == 5 and len({(r.sequence_id, r.offset) for r in out}) == 5
    with pytest.raises(ValueError):
        packed(spark.createDataFrame([(1, 0, 2000)], "doc_id long, start long, length long"))
