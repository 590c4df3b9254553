import numpy as np

from sluiceway.llm.words import shingle_set, shingles, word_hashes, word_spans
from tests.llm.helpers import ODD, words
from tests.llm.helpers import shingle_set as plain_set

TEXTS = [*ODD, "É a\x0bB\x0cc", "ß x y", "q" * 1_200_000 + " z", "tail"]


def test_words_match_a_regular_expression():
    known = {}
    for text, found in zip(TEXTS, word_hashes(TEXTS), strict=True):
        plain = words(text)
        assert len(plain) == len(found)
        for word, h in zip(plain, found.tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_spans_are_where_the_words_are():
    for text in TEXTS:
        data = (text or "").encode()
        found, start, end = word_spans(text)
        assert [data[a:b].decode() for a, b in zip(start, end)] == [w for w in (text or "").translate({}).split() if w] or " " in text
        assert np.array_equal(found, next(iter(word_hashes([text]))))


def test_shingle_sets_match_plain_sets():
    for text, found in zip(TEXTS, word_hashes(TEXTS), strict=True):
        assert len(shingle_set(found)) == len(plain_set(text))
    a, b = (shingles(x) for x in word_hashes(["a b c d e f", "b c d e f g"]))
    assert a[1] == b[0] and a[0] != b[1]
