"""Periodic runs: stretches of a text that say the same words over and over.

A run of period q has at least ``COPIES`` periods and ``LEAST`` words, so the words that equal those
q words on lie side by side on the diagonal of lag q, at least max(LEAST - q, (COPIES - 1) q) of
them. Within a text,

1. *Seed.* For lags up to 16, and for those of (k/2, k] with k = 32, 64, ..., the k-grams are indexed: every such
   run holds a k-gram and the same one a period later. Grams have exact numbers, made by doubling
   from pairs of grams of half the length; a gram that occurs once is in no longer one that
   recurs, so few are left after the first steps.
2. *Pairs.* As a k-gram is no shorter than the periods it is used for, it cannot recur within a
   period of its run: the next occurrence is exactly one period on. So only neighbouring
   occurrences are paired, and a gram with n of them gives n - 1 pairs.
3. *Extend.* A pair is followed along its diagonal to both sides. A table has, for each lag, how
   far it is covered; a pair inside is part of a stretch that was extended before.

Many texts are done at once: their words have numbers of their own, so nothing is found across.
The work is that of sorting a text's words once per length of grams that recur.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 24  # words
COPIES = 3
_FIRST = 16
_BATCH = 1 << 18  # words
assert _FIRST <= LEAST - _FIRST // 2 and COPIES == 3, "a gram has to fit in the least overlap"


def _following(same: np.ndarray, grams: np.ndarray, at: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of twice the length that recur: numbers, and where they start.

    ``grams`` has the numbers of those of length ``half`` that recur, starting ``at``; ``same`` is scratch.
    """
    same[at] = grams
    inside = at + half < len(same)
    first, start = grams[inside], at[inside]
    second = same[start + half]
    there = second >= 0
    first, second, start = first[there], second[there], start[there]
    same[at] = -1
    if not len(start):
        return first, start
    return _recurring(first * (int(grams.max()) + 1) + second, start)


def _recurring(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for equal keys, of those that occur twice and more, and their places."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    number = np.cumsum(new & ~alone) - 1
    return number[~alone], at[~alone]


def _agreeing(a: np.ndarray, low: int, high: int, lag: int) -> tuple[int, int]:
    """The widest [low, high) in which each word equals that ``lag`` words on."""
    step = 64
    while high + lag < len(a):
        size = min(step, len(a) - lag - high)
        differ = a[high : high + size] != a[high + lag : high + lag + size]
        if differ.any():
            high += int(differ.argmax())
            break
        high, step = high + size, 2 * step
    step = 64
    while low > 0:
        size = min(step, low)
        differ = (a[low - size : low] != a[low - size + lag : low + lag])[::-1]
        if differ.any():
            low -= int(differ.argmax())
            break
        low, step = low - size, 2 * step
    return low, high


def runs_in(a: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) among numbered words, by start, then period.

    Texts may stand side by side in ``a`` if no number is in two of them; ``longest`` is the
    length of the longest text.
    """
    longest = len(a) if longest is None else longest
    if longest < LEAST:
        return []
    found = []
    covered: dict[int, int] = {}
    same = np.full(len(a), -1, np.int64)
    grams, at, k = *_recurring(a.astype(np.int64), np.arange(len(a))), 1
    while len(at):
        if k >= _FIRST:
            near = (grams[1:] == grams[:-1]) & (at[1:] - at[:-1] <= min(k, longest // COPIES))
            if k > _FIRST:
                near &= at[1:] - at[:-1] > k // 2
            place, lag = at[:-1][near], (at[1:] - at[:-1])[near]
            order = np.lexsort((place, lag))
            place, lag = place[order], lag[order]
            start = np.ones(len(place), bool)  # the others continue the pair before
            start[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
            for i, q in zip(place[start].tolist(), lag[start].tolist(), strict=True):
                if i < covered.get(q, 0):
                    continue
                low, high = _agreeing(a, i, i + k, q)
                covered[q] = high
                if high + q - low >= max(LEAST, COPIES * q):
                    found.append((low, high + q - low, q))
        if 2 * k > longest:
            break
        grams, at = _following(same, grams, at, k)
        k *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _read(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of texts, and numbers for them that no two texts share."""
    # Without arguments, bytes are split at space and \x09-\x0d only.
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    numbers, used = [], 0
    for w in words:
        known: dict[bytes, int] = {}
        numbers.append(np.array([known.setdefault(x, used + len(known)) for x in w], np.int64))
        used += len(known)
    return words, np.concatenate(numbers) if numbers else np.empty(0, np.int64)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def collapsed_runs(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Each text's runs, and its words without those that repeat a run's first period."""
    words, a = _read(texts)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_in(a, max(map(len, words), default=0)):
        i = int(np.searchsorted(ends, start, "right"))
        found[i].append((start - int(ends[i]) + len(words[i]), length, period))
    return [(r, _collapsed(w, r)) for w, r in zip(words, found, strict=True)]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): doc_id, runs, collapsed.

    Words are longest runs of characters other than space and ``\\x09``-``\\x0d``, as they are
    written. ``runs`` has a struct (start, length, period) for every stretch of words whose smallest
    period is ``period``, of 24 words and three periods or more, that no neighbouring word continues,
    by start, then period; places are numbers of words from 0. Runs may overlap. ``collapsed`` is the text
    without the words that any run contains after its first period, words joined by one space.

    A null text is an empty one and has no runs. Whole texts are read, whatever their length; a
    text takes about a hundred bytes of memory a word. Repeated rows, ids or null ids have
    each their row; nothing is compared across rows, so nothing is shuffled. An empty table gives no
    rows; other columns are ignored.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            batch = np.cumsum([len(t or "") // 5 for t in texts]) // _BATCH
            for low, high in itertools.pairwise([0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(texts)]):
                done = collapsed_runs(texts[low:high])
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in done]
                yield pd.DataFrame({"doc_id": frame["doc_id"].array[low:high], "runs": runs, "collapsed": [c for _, c in done]})

    # Ids as text: pandas would turn longs with a null among them into floats.
    kind = docs.schema["doc_id"].dataType
    given = docs.selectExpr("cast(doc_id as string) doc_id", "text")
    found = given.mapInPandas(rows, "doc_id string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumn("doc_id", found["doc_id"].cast(kind))
