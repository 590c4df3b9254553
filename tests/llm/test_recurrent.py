import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sluiceway.llm import gru, recurrent
from sluiceway.llm.recurrent import count_words, know, score, train
from tests.llm.helpers import DOCS, ODD, documents, prose, words


def test_base_score_and_counts_equal_plain_python(spark):
    texts = [*ODD, *(prose(i, 30 + i, 300) for i in range(60))]
    docs = documents(spark, texts).withColumns({"row": F.lit(1), "word": F.lit(2), "log": F.lit(3)}).repartition(3)
    rows = {r.doc_id: r for r in score(docs).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i in tokens if not out[i] for w in tokens[i])
    total, distinct = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for i, w in tokens.items():
        r = rows[i]
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and math.isfinite(r.score) and r.score < 0


def test_order_is_learnt_and_held_out_texts_profit(spark):
    cycle = [f"c{k}" for k in range(40)]
    texts = [" ".join(cycle[(s + k) % 40] for k in range(200)) for s in range(300)]
    rows = [r for r in score(documents(spark, texts)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_null_ids_repeated_rows_empty_tables_and_nothing_to_learn(spark):
    rows = [(5, "a b"), (5, "a b"), (None, "a c"), (6, None)]
    out = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and len({(r.doc_id, r.base_score) for r in out}) == 3
    assert score(spark.createDataFrame([], DOCS)).collect() == []
    alone = score(spark.createDataFrame(rows, "doc_id long, text string"), out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in alone)


def small_model():
    model = gru.Model.first(np.array([9, 5, 4, 2, 1]), 3, hidden=4)
    model.vector[...] += np.random.default_rng(0).normal(0, 0.2, model.vector.shape).astype(np.float32)
    padded = model.word_bias < -1e3
    model.word_bias[padded] = -1e4
    return model


def test_probabilities_of_the_next_word_add_up_to_one():
    model = small_model()
    first = gru.run(model, np.array([2, 0]), np.array([2]), start=0)[0]
    each = [gru.run(model, np.array([2, w]), np.array([2]), start=0)[0] for w in range(6)]
    assert abs(first - each[0]) < 1e-6
    alone = gru.run(model, np.array([2]), np.array([1]), start=0)[0]
    assert abs(sum(math.exp(x - alone) for x in each) - 1) < 1e-4


def test_state_is_carried_across_windows_and_not_across_documents():
    model, rnd = small_model(), np.random.default_rng(1)
    sizes = np.array([70, 3, 1, 40, 16, 17])
    tokens = rnd.integers(0, 6, sizes.sum())
    want = gru.run(model, tokens, sizes, start=0, streams=1, steps=1)
    for streams, steps in ((1, 16), (2, 5), (6, 16), (50, 100)):
        assert np.allclose(gru.run(model, tokens, sizes, start=0, streams=streams, steps=steps), want, rtol=1e-4)


def test_gradients_match_differences():
    model, rnd = small_model(), np.random.default_rng(2)
    sizes, tokens = np.array([6, 4]), rnd.integers(0, 6, 10)
    held = {}
    gru.run(model, tokens, sizes, start=0, learn=held.update, streams=2, steps=8)
    for name in ("state", "of_class", "class_bias", "of_word", "word_bias", "inputs"):
        g = held[name]
        dense = np.zeros_like(getattr(model, name))
        if isinstance(g, tuple):
            dense[g[0]] = g[1]
        else:
            dense = g
        flat = getattr(model, name).reshape(-1)
        for k in np.argsort(-np.abs(dense.reshape(-1)))[:5]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = gru.run(model, tokens, sizes, start=0).sum()
            flat[k] = old - 1e-2
            down = gru.run(model, tokens, sizes, start=0).sum()
            flat[k] = old
            assert abs(-(up - down) / 2e-2 / 10 - dense.reshape(-1)[k]) < 2e-3, name


def test_every_word_of_every_document_trains(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(recurrent.gru, "run", lambda model, tokens, sizes, **_: learnt.append((tokens, sizes)))
    texts = [prose(i, n, 10**6) for i, n in enumerate((1, 127, 128, 300, 5000))] + [None]
    known = know(count_words(documents(spark, texts)))

    class Here:
        """Stands for a frame of documents whose tasks run in this process."""

        sparkSession = spark

        def filter(self, *_):
            return self

        select = filter

        def mapInPandas(self, learn, _):
            list(learn(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])))
            return spark.createDataFrame([], "piece int, weight double, numbers array<float>")

    train(Here(), known)
    every = np.concatenate([np.append(w, recurrent.END) for w in recurrent.word_hashes(texts)])
    assert np.bincount(np.concatenate([x for x, _ in learnt])).tolist() == np.bincount(known.numbers(every)).tolist()
    assert all(n.max() <= recurrent.SEGMENT for _, n in learnt)


def plain_log(model, tokens):
    """The log-probability of one document, a word at a time, in double precision."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    by = {k: getattr(model, k).astype(float) for k in ("inputs", "state", "of_class", "class_bias", "of_word", "word_bias")}
    softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    h, before, total, size = np.zeros(model.hidden), 0, 0.0, model.hidden
    for t in tokens:
        a, u = by["inputs"][before], h @ by["state"]
        z, r = np.split(sigmoid(a[: 2 * size] + u[: 2 * size]), 2)
        h = (1 - z) * np.tanh(a[2 * size :] + r * u[2 * size :]) + z * h
        c = min(int(t) // gru.CLASS, model.classes) if t < model.vocabulary else model.classes
        total += softmax(h @ by["of_class"] + by["class_bias"])[c]
        if c < model.classes:
            total += softmax(h @ by["of_word"][c] + by["word_bias"][c])[t % gru.CLASS]
        before = t
    return total


def test_scores_equal_plain_ones_however_large_the_logits():
    rnd = np.random.default_rng(4)
    for scale in (0.2, 1, 40):
        model = gru.Model.first(np.arange(200, 0, -1), 30, hidden=8)
        padded = model.word_bias < -1e3
        model.vector[...] += rnd.normal(0, scale, model.vector.shape).astype(np.float32)
        model.word_bias[padded] = -1e4
        sizes = np.array([3, 700, 1, 40])
        tokens = rnd.integers(0, 230, sizes.sum())
        want = [plain_log(model, x) for x in np.split(tokens, np.cumsum(sizes)[:-1])]
        assert np.allclose(gru.run(model, tokens, sizes, start=0), want, rtol=1e-3)


def test_exponentials_are_taken_for_all_classes_of_a_window_at_once(monkeypatch):
    made, real = [], gru.np.exp
    monkeypatch.setattr(gru.np, "exp", lambda x, *a, **b: (made.append(x.shape), real(x, *a, **b))[1])
    tokens, n = np.random.default_rng(5).integers(0, 64 * gru.CLASS, 1024), 64
    for learn in (None, lambda grads: None):
        made.clear()
        gru.run(gru.Model.first(np.ones(64 * gru.CLASS), 9), tokens, np.full(n, 1024 // n), start=0, learn=learn)
        assert len(made) <= 2


def test_frequent_words_are_found_as_by_binary_search(spark):
    known = know(count_words(documents(spark, [prose(i, 400, 3000) for i in range(9)])))
    rnd = np.random.default_rng(6)
    words = np.concatenate([known.words, known.words + np.uint64(1), rnd.integers(0, 2**64, 5000, np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
    at, there = known.find(words)
    assert (at == np.minimum(np.searchsorted(known.words, words), len(known.words) - 1)).all()
    assert there.tolist() == np.isin(words, known.words).tolist()
