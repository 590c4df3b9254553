import sys

import numpy as np
from pyspark.sql import functions as F

from sluiceway.llm.substrings import (
    _alike_rows,
    _around,
    _compared,
    _recurring,
    _signed,
    _unheld,
    _within,
    alike,
    repeated_passages,
    sliding_minima,
    window_rows,
    without_repeats,
)
from sluiceway.llm.words import mix, shingles, word_hashes
from tests.llm.helpers import DOCS, ODD, documents, edited, prose, words


def exact_repeats(texts, least=50):
    """Per document, the words in runs of ``least`` that an earlier document has."""
    seen, out = {}, {}
    for i, text in enumerate(texts):
        w = words(text)
        for a in range(len(w) - least + 1):
            run = tuple(w[a : a + least])
            if seen.setdefault(run, i) != i:
                out.setdefault(i, set()).update(range(a, a + least))
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return out


def corpus():
    passage, other = prose(1, 51), prose(2, 140)
    texts = [prose(100 + i, 60 + i) for i in range(30)]
    texts += [prose(200 + i, 40) + " " + passage + " " + prose(300 + i, 30) for i in range(40)]
    texts += [prose(400 + i, 10) + " " + other for i in range(10)]
    line = prose(3, 14)
    texts += [prose(500 + i, 30) + " " + line + " " + prose(600 + i, 30) for i in range(60)]
    texts += ["again and " * 60, "again and " * 40 + "x"]
    return [*ODD, *texts]


def test_all_exact_repeats_are_found_and_little_else(spark):
    texts = corpus()
    rows = repeated_passages(documents(spark, texts).withColumns({"key": F.lit(1), "place": F.lit(2)}).repartition(5)).collect()
    want, got = exact_repeats(texts), covered(rows)
    assert set(got) == set(want)
    for i in want:
        assert want[i] <= got[i] and len(got[i] - want[i]) <= 12
    sets = [words(t) for t in texts]
    for r in rows:
        a = {tuple(sets[r.doc_id][k : k + 5]) for k in range(r.start, r.end - 4)}
        b = {tuple(sets[r.source_id][k : k + 5]) for k in range(r.source_start, r.source_end - 4)}
        assert r.source_id < r.doc_id and r.end - r.start >= 50
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_near_copies_of_passages_are_found(spark):
    passage = prose(5, 150)
    texts = [prose(700 + s, 50) + " " + edited(passage, s, 150) + " " + prose(800 + s, 50) for s in range(30)]
    got = covered(repeated_passages(documents(spark, texts)).collect())
    # Any two copies differ in two words, so their similarity is about 0.87.
    assert sum(len(got.get(i, ())) > 100 for i in range(1, 30)) >= 27


def test_cut_texts_hold_each_passage_once(spark):
    texts = corpus()
    docs = documents(spark, texts).withColumn("start", F.lit(9))
    out = {r.doc_id: r for r in without_repeats(docs, repeated_passages(docs)).collect()}
    assert len(out) == len(texts) and docs.columns == list(out[0].asDict())
    repeats = exact_repeats(texts)
    for i, text in enumerate(texts):
        if i not in repeats:
            assert out[i].text == text
        else:
            assert out[i].n_chars == len(out[i].text)
    assert not exact_repeats([out[i].text for i in sorted(out)], 53)


def test_null_ids_repeated_rows_and_empty_table(spark):
    same = prose(8, 80)
    rows = [(1, same), (1, same), (None, same), (2, same), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(covered(repeated_passages(docs).collect())) == {2}
    assert without_repeats(docs, repeated_passages(docs)).count() == 5
    assert repeated_passages(spark.createDataFrame([], DOCS)).collect() == []


def test_windows_are_those_of_the_cartesian_tree():
    h = np.random.default_rng(1).integers(0, 50, 200)
    for length in (1, 2, 7, 46, 200):
        assert sliding_minima(h, length).tolist() == [a + int(np.argmin(h[a : a + length])) for a in range(len(h) - length + 1)]
    tokens = [shingles(w) for w in word_hashes([prose(1, 300), "", prose(2, 49), prose(3, 50)])]
    text, key, place = window_rows(tokens)
    assert set(text.tolist()) == {0, 3} and len(key) == len(place)


def test_a_changed_word_at_any_place_of_a_short_passage_loses_nothing():
    def tokens(text):
        return shingles(next(iter(word_hashes([text]))))

    for size in range(50, 71):
        passage = prose(size, size).split(" ")
        for at in range(size):
            other = [*passage[:at], "changed", *passage[at + 1 :]]
            a, b = (tokens(" ".join([prose(s, 45), *x, prose(s + 1, 45)])) for s, x in ((900, other), (950, passage)))
            p, q = set(a[45 : 41 + size].tolist()), set(b[45 : 41 + size].tolist())
            assert len(p & q) / len(p | q) >= 0.8
            spans = alike(a, b)
            assert spans, (size, at)
            held = set().union(*(range(i, j) for i, j, *_ in spans))
            assert len(held & set(range(45, 41 + size))) >= 46 - 5, (size, at)
            for i, j, k, l, s in spans:
                p, q = set(a[i:j].tolist()), set(b[k:l].tolist())
                assert min(j - i, l - k) >= 46 and s >= 0.8 and abs(s - len(p & q) / len(p | q)) < 1e-9


def test_a_variant_of_a_variant_is_found_though_both_share_its_key_with_a_third(spark):
    first, second, third = [], [], []
    for n in range(40):
        w = prose(3000 + n, 60, 10**6).split(" ")
        first.append(" ".join(w))
        w[20] = "second"
        second.append(" ".join(w))
        w[40] = "third"
        third.append(" ".join(w))
    rows = repeated_passages(documents(spark, [*first, *second, *third])).collect()
    got = covered(rows)
    keys = [set(window_rows([shingles(h)])[1].tolist()) for h in word_hashes([*first, *second, *third])]
    meet = [n for n in range(40) if keys[40 + n] & keys[80 + n]]
    chained = [n for n in meet if keys[n] & keys[40 + n] and not keys[40 + n] & keys[80 + n] - keys[n]]
    assert chained and [n for n in meet if 80 + n not in got] == []
    assert all(r.source_id == r.doc_id - 40 for r in rows)


def test_a_passage_that_overlaps_a_found_one_is_found(spark):
    whole = [prose(4000 + n, 105, 10**6).split(" ") for n in range(10)]
    texts = [" ".join(w[:100]) for w in whole]
    texts += [f"{prose(4100 + n, 30)} {' '.join(w[55:])}" for n, w in enumerate(whole)]
    texts += [" ".join(w) for w in whole]
    got = covered(repeated_passages(documents(spark, texts)).collect())
    assert all(got.get(20 + n) == set(range(105)) for n in range(10))


def test_near_copies_at_the_threshold_meet_at_a_single_start():
    texts = [prose(5000 + n, 50, 10**6).split(" ") for n in range(1000)]
    other = [" ".join([*w[:25], "changed", *w[26:]]) for w in texts]
    tokens = [shingles(h) for h in word_hashes([" ".join(w) for w in texts] + other)]
    text, key, _ = window_rows(tokens)
    keys = [set() for _ in tokens]
    for n, k in zip(text.tolist(), key.tolist()):
        keys[n].add(k)
    assert [n for n in range(1000) if not keys[n] & keys[1000 + n]] == []


def test_stretches_that_fail_are_not_looked_at_one_by_one():
    a = np.random.default_rng(3).permutation(10**6)[:180].astype(np.uint64)
    b = a.copy()
    b[4::7] += np.uint64(10**7)  # 0.75 alike
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = alike(a, b)
    finally:
        sys.setprofile(None)
    assert found == [] and calls < 1500


def test_cut_texts_go_to_python_before_the_result_is_written(spark):
    docs = documents(spark, [prose(8, 80), None, prose(8, 80) + " more", prose(9, 60)])
    out = without_repeats(docs, repeated_passages(docs))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {0: (prose(8, 80), len(prose(8, 80))), 1: (None, 0), 2: ("more", 4), 3: (prose(9, 60), len(prose(9, 60)))}


def _rows(tokens, place=45):
    return _around(tokens, np.array([place]))


def test_rows_whose_stretches_are_alike_are_never_told_apart():
    r = np.random.default_rng(5)
    found = 0
    for n in range(600):
        a = mix(r.integers(0, (40, 200, 10**9)[n % 3], 91).astype(np.uint64))
        if n % 4 == 0:
            a = np.tile(a[:31], 3)[:91]
        b = a.copy()
        for at in r.integers(0, 91, r.integers(0, 4)):
            b[at : at + 5] = mix(r.integers(10**10, 10**12, len(b[at : at + 5])).astype(np.uint64))
        _, bound = _compared(_rows(a), np.array([0]), _rows(b), np.array([0]), np.array([45]))
        found += bool(alike(a, b))
        assert bound[0] >= 0 or not alike(a, b)
    assert found > 100


def test_rows_of_another_period_are_told_apart_by_their_tokens():
    a = np.tile(mix(np.arange(31, dtype=np.uint64)), 3)[:91]
    b = np.tile(mix(np.concatenate([np.arange(26), np.arange(100, 105)]).astype(np.uint64)), 3)[:91]
    missing, bound = _compared(_rows(a), np.array([0]), _rows(b), np.array([0]), np.array([45]))
    assert missing[0] <= 9 and bound[0] < 0 and alike(a, b) == []


def test_only_starts_that_no_passage_explains_ask():
    fresh = np.zeros(200, bool)
    fresh[[*range(20, 31), *range(150, 161)]] = True
    stretches = _unheld(fresh)
    assert all(fresh[s : s + 46].sum() > 9 for a, b in stretches for s in (a, b))
    run, low, high = _within(np.array([10, 60, 100]), np.array([50, 90, 140]), stretches)
    assert set(run.tolist()) == {0, 2} and (low <= high).all()
    for s in range(155):
        inside = [k for k, x, y in zip(run, low, high) if x <= s <= y]
        assert inside == [k for k, x, y in ((0, 10, 50), (1, 60, 90), (2, 100, 140)) if x <= s <= y and fresh[s : s + 46].sum() > 9]


def test_a_stretch_reaches_over_a_changed_word_to_more_common_ones():
    a = np.random.default_rng(6).permutation(10**6)[:120].astype(np.uint64)
    b = a.copy()
    b[90:95] += np.uint64(10**7)  # a changed word, and then 7 common shingles, fewer than 3 for each changed one
    b[102:] += np.uint64(10**7)
    assert [(i, j) for i, j, *_ in alike(a, b)] == [(0, 102)]


def test_a_periodic_text_is_compared_once_for_each_document():
    def rows(doc_id, tokens, asks):
        place = np.arange(45, len(tokens) - 46, 31)
        n = len(place)
        return _signed(doc_id, tokens, np.ones(n, np.int64), place << 12, np.full(n, asks), np.ones(n, int), np.ones(n, int))

    tokens = np.tile(mix(np.arange(31, dtype=np.uint64)), 40)
    first, second = rows(1, tokens, False), rows(2, tokens, True)
    assert len(first) == 1 and len(second) > 30
    f = {c: np.concatenate([first[c], second[c]]) for c in first}
    found = np.concatenate(list(_alike_rows(f, np.zeros(len(f["key"]), int))))
    assert len(found) == len(second) and set(found[:, 4].tolist()) == {1} and set(found[:, 5].tolist()) == {45}


def test_what_a_text_repeats_within_itself_does_not_recur(spark):
    texts = [prose(1, 60) + " " + prose(1, 60), prose(2, 60), prose(2, 60) + " more"]
    recurring = _recurring(documents(spark, texts))
    own, shared, _ = (shingles(h) for h in word_hashes(texts))
    assert recurring.has(own).mean() < 0.5 and recurring.has(shared).all()
