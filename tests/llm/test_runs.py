import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import runs as module
from sluiceway.llm.queries import op12_periodic_runs
from sluiceway.llm.runs import collapsed_runs, periodic_runs, runs_in
from tests.llm.helpers import DOCS, ODD, WORD, documents, prose


def plain(w):
    """All runs by comparing each word with the word each lag on."""
    found, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n or doc_id is None:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    """What the query has to return for a document."""
    w = looped(doc_id, WORD.findall(text or ""))
    found = plain(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def repetitive(seed):
    """Words of a small alphabet with stretches that repeat, in one another too."""
    rnd = random.Random(seed)
    alphabet = rnd.choice([1, 2, 3, 40])
    w = [rnd.randrange(alphabet) for _ in range(rnd.randrange(120))]
    for _ in range(rnd.randrange(4)):
        unit = [rnd.randrange(alphabet) for _ in range(rnd.randrange(1, 30))]
        if rnd.random() < 0.4:
            unit = unit * 3 + unit[: rnd.randrange(len(unit) + 1)] + [99]
        stretch = (unit * 40)[: int(len(unit) * rnd.uniform(2.5, 6))]
        at = rnd.randrange(len(w) + 1)
        w[at:at] = stretch
    return w


@pytest.mark.parametrize("seed", range(250))
def test_runs_equal_brute_force(seed):
    w = repetitive(seed)
    assert runs_in(np.array(w, np.int64)) == plain(w)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65])
def test_shortest_runs_of_each_period_and_just_too_short_ones(period):
    unit = [f"u{i}" for i in range(period)]
    size = max(24, 3 * period)
    for length in (size - 1, size, size + 1):
        w = [f"a{i}" for i in range(13)] + (unit * length)[:length] + [f"b{i}" for i in range(5)]
        _, a = module._read([" ".join(w)])
        assert runs_in(a) == ([(13, length, period)] if length >= size else [])


def test_texts_side_by_side_are_apart():
    texts = ["a b " * 11, "a b " * 12, "", None, "b " * 12, "b " * 12 + "c " * 23, " ".join(["x y z"] * 8 + ["q"] * 24)]
    for text, (found, collapsed) in zip(texts, collapsed_runs(texts), strict=True):
        w = (text or "").split()
        assert found == plain(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_a_long_uniform_text_takes_linear_work():
    a = np.zeros(2_000_000, np.int64)
    assert runs_in(a) == [(0, 2_000_000, 1)]


def test_odd_texts_ids_and_columns(spark, monkeypatch):
    monkeypatch.setattr(module, "_BATCH", 4)  # of use where the workers inherit it
    texts = [*ODD[:9], "\x1f \x85\xa0   é́ " * 30, "a\x0bb\tc\r\nd\x0c" * 12, "A a " * 12, "a  a\n" * 40]
    docs = documents(spark, texts).withColumns({"runs": F.lit("r"), "collapsed": F.lit("c"), "n": F.lit(1)})
    docs = docs.unionByName(docs.filter("doc_id = 11")).unionByName(docs.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    got = periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"] and dict(got.dtypes)["doc_id"] == "bigint"
    rows = got.collect()
    assert len(rows) == len(texts) + 2 and sum(r.doc_id == 11 for r in rows) == 2
    for r in rows:
        w = WORD.findall(texts[12 if r.doc_id is None else r.doc_id] or "")
        assert [tuple(x) for x in r.runs] == plain(w)
    assert periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    texts = [prose(i, 1 + 7 * (i % 40)) for i in range(150)] + [" ".join(map(str, repetitive(i))) for i in range(80)] + ODD[:8]
    docs = documents(spark, texts).unionByName(documents(spark, ["p q r " * 9]).withColumn("doc_id", F.lit(None).cast("long")))
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    frame = op12_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in frame.dtypes] == ["bigint"] * 6 + ["string"] * 2
    got = {r.doc_id: tuple(r) for r in frame.collect()}
    want = {i: digest(i, t) for i, t in enumerate(texts)} | {None: digest(None, "p q r " * 9)}
    assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 40
