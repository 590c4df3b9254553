"""Documents for the tests, and plain Python to hold the operators against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def prose(seed, n, vocabulary=5000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, every):
    w, rnd = text.split(" "), random.Random(seed)
    for k in range(rnd.randrange(every), len(w), every):
        w[k] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


#: Null, empty, blank, short, repeated and very long texts.
ODD = [None, "", " \n\t", "one", "One", "a b c d", "a b c d", "a b c d e", "x" * 300_000, "y " * 60_000, prose(0, 3000)]
