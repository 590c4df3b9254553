"""Passages of fifty words and more that repeat, near-copies included.

0. Texts that are wholly those of an earlier document are repeats as they are. Of the others, shingles
   that two texts and more have are found by buckets, and put in a bitmap that goes to all tasks: only
   windows in which 80 per cent recur can be passages, and the rest is left out from here on.
1. The tokens of a text are its word shingles. Under a hash function, the Cartesian tree of a
   text splits it at the least hash, then each part at its own least: a node (l, c, r) stands for
   all subsequences within l..r that hold c, which share the min-hash of c. Of nodes with room
   for ``LEAST`` tokens the subsequences of that length are the starts whose sliding minimum is
   at c; so sliding minima give these compact windows without recursion.
2. Within a text, windows of two hash functions are joined as intervals: a run of starts that
   share both minima makes one row with both as its key. ``BANDS`` such pairs are used, so
   passages at similarity s meet with a probability of 1 - (1 - s * s)^BANDS at each start,
   and exact copies always.
3. Keys are counted, and those that occur once are left out.
4. Each row of a key is paired with the key's first row, by document and place. Pairs of the
   same two documents are joined to one; the shingles around their places are compared, and
   the stretches that agree are verified by the Jaccard similarity of their exact shingle sets.
   A stretch reaches over shingles that differ to more that agree, while it is similar enough.
5. A window is explained if the passages found hold all but ``MISSING`` of its shingles that
   recur. Starts that are left are compared with all rows of their key, in blocks, by bitmaps and then
   by the shingles around them, and what may be alike is verified in the same way. Rows of one document
   that hold the same shingles, as in a periodic text, are compared once.

A passage repeats if one of a document with a smaller id is like it. Every group, however
large, costs a pair per row in step 4; in step 5 a row that is left costs a pair with each
row of its key, as any of them may be what it repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.mixing import word_count
from sluiceway.llm.tables import likely, look_up, saved, unlikely, whole_groups
from sluiceway.llm.words import SHINGLE, mix, shingles, signed, word_hashes, word_spans

WORDS = 50
LEAST = WORDS - SHINGLE + 1  # tokens
SIMILAR = 80  # per cent
BANDS = 10
WIDE = 2 * LEAST  # tokens around places with the first row of a key
BLOCK = 2048
MISSING = LEAST * (100 - SIMILAR) // 100
_BUCKET = 1 << 20
_MOST = 1 << 28  # bits
_SEEDS = mix(np.arange(101, 101 + 2 * BANDS, dtype=np.uint64)).reshape(BANDS, 2)
_SKETCH = 512
_REACH = 2 * LEAST - 1
_AT = np.arange(_REACH)
_NONE = np.int16(-(1 << 14))  # a score that nothing reaches
_ROWS = 20_000  # rows compared at a time,
_PAIRS = 1 << 14  # pairs of them,
_ASKING = 256  # and rows that ask
_POWERS = mix(np.arange(1, _REACH + 1, dtype=np.uint64)) | np.uint64(1)
_TOKEN, _AGAIN, _EVER = 0x3FFF, 0x4000, 0x8000
_PART = 1 << 18  # tokens of stretches looked at together
_CANDIDATES = "doc_id long, place long, first long, last long, source_id long, source_place long, missing long"
SPANS = "doc_id long, start long, end long, source_id long, source_start long, source_end long, similarity double"


def sliding_minima(h: np.ndarray, length: int) -> np.ndarray:
    """For each start, where the (first) least of the next ``length`` values is."""
    at, span = np.arange(len(h)), 1
    while span < length:
        step = min(span, length - span)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        span += step
    return at


def window_rows(tokens: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of several texts: index of the text, key, place of the first minimum."""
    return window_runs(tokens, least)[:3]


def window_runs(tokens: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """The same, and the first and last of the starts that share the key."""
    sizes = np.array([len(x) for x in tokens], np.int64)
    ends = np.cumsum(sizes)
    if not len(sizes) or ends[-1] < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    every = np.concatenate(tokens)
    starts = np.arange(len(every) - least + 1)
    text = np.searchsorted(ends, starts, "right")
    whole = starts + least <= ends[text]
    out = []
    for band, seeds in enumerate(_SEEDS):
        h = [mix(every ^ seed) for seed in seeds]
        one, two = (sliding_minima(x, least) for x in h)
        new = np.ones(len(starts), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])
        run = np.flatnonzero(new & whole)
        edges = np.append(np.flatnonzero(new | ~whole), len(starts))
        last = edges[np.searchsorted(edges, run, "right")] - 1
        key = mix(mix(h[0][one[run]] + np.uint64(band)) + h[1][two[run]])
        base = (ends - sizes)[text[run]]
        out.append((text[run], key, one[run] - base, run - base, last - base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Recurring:
    """A set of shingles that holds all that two texts and more have, and few others.

    Shingles are dealt into buckets by their upper bits, and known there by their lower 32, so
    a shingle passes for another with odds of 1 to 4,000 at most. The bitmap has 16 bits for each that
    recurs, up to ``_MOST`` bits; beyond that it lets more pass, which costs time and loses nothing.
    """

    def __init__(self, bits: np.ndarray, buckets_log: int):
        self.bits, self.buckets_log = bits, np.uint64(buckets_log)

    def has(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.bits):
            return np.zeros(len(tokens), bool)
        at = mix(_bucketed(tokens, self.buckets_log)) & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _bucketed(tokens: np.ndarray, buckets_log: np.uint64) -> np.ndarray:
    return (tokens >> (np.uint64(64) - buckets_log)) << np.uint64(32) | tokens & np.uint64(0xFFFFFFFF)


def _recurring(docs: DataFrame) -> _Recurring:
    """The shingles that more than one text has.

    What a text repeats within itself no other needs to have. A task drops copies before it deals out a million words, but for one, so that a bucket gets no
    more than two of a shingle from these; there are as many buckets as million words.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    log = min(20, max(6, math.ceil(math.log2(1 + chars / 5 / _BUCKET))))

    least = np.arange(1 << log, dtype=np.uint64) << np.uint64(64 - log)  # token of each bucket

    def dealt(held: list[np.ndarray]) -> pd.DataFrame:
        seen = np.concatenate(held)
        held.clear()
        seen.sort()
        again = seen[1:] == seen[:-1]  # of what is there more than twice, two stay
        seen = seen[np.concatenate(([True, True], ~(again[1:] & again[:-1])))[: len(seen)]]
        edges = np.append(np.searchsorted(seen, least), len(seen))
        bucket = np.flatnonzero(edges[1:] > edges[:-1])
        parts = [seen[a:b].astype(np.uint32).tobytes() for a, b in zip(edges[bucket], edges[bucket + 1], strict=True)]
        return pd.DataFrame({"bucket": bucket, "tokens": parts})

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            for words in word_hashes(frame["text"]):
                held.append(np.unique(shingles(words)))
                n += len(held[-1])
                if n > _BUCKET:
                    yield dealt(held)
                    held, n = [], 0
        if n:
            yield dealt(held)

    def recur(frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in frame["tokens"]]))
        twice = np.unique(seen[1:][seen[1:] == seen[:-1]]).astype(np.uint64)
        return pd.DataFrame({"key": signed(mix(np.uint64(frame["bucket"].iloc[0]) << np.uint64(32) | twice))})

    found = docs.mapInPandas(deal, "bucket long, tokens binary").groupBy("bucket").applyInPandas(recur, "key long")
    found = saved(found, "recurring")
    n = found.count()
    words = min(_MOST, 1 << max(10, math.ceil(math.log2(16 * n + 1)))) // 64
    word = F.expr(f"shiftrightunsigned(key, 6) & {words - 1}")
    bits = found.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits"))
    table = bits.toArrow()  # at most _MOST / 64 rows of two numbers
    out = np.zeros(words, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return _Recurring(out, log)


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, pd.DataFrame]]:
    """The shingles of some texts at a time, their places in the frame, and the frame."""
    for frame in frames:
        held, first, n = [], 0, 0
        for i, words in enumerate(word_hashes(frame["text"])):
            held.append(shingles(words))
            n += len(words)
            if n > size or i + 1 == len(frame):
                yield held, np.arange(first, i + 1), frame
                held, first, n = [], i + 1, 0


def _windows(docs: DataFrame, recurring, *, rest: bool = False) -> DataFrame:
    """Rows key, doc_id, spot of the windows in which at most ``MISSING`` shingles do not recur.

    A passage has a stretch of ``LEAST`` shingles of which 80 per cent are in another one. So the
    hashes are computed only around such windows. A spot is 4096 times the place of the first
    minimum, 64 times what the first start is before it, and how many starts follow. With
    ``rest``, docs have passages ``found``, and windows with at most ``MISSING`` recurring shingles out
    of these are left out.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, at, frame in _batches(frames, 200_000):
            base = np.cumsum([0, *map(len, held)])
            every = np.concatenate(held)
            known = recurring.value.has(every)
            stretch = _promising(~known, base)
            if not len(stretch):
                continue
            text, key, place, low, high = window_runs([every[a:b] for a, b in stretch])
            place, low, high = (x + stretch[text, 0] for x in (place, low, high))
            if rest:
                fresh = known.copy()
                for start, end, spans in zip(base, base[1:], frame["found"].iloc[at], strict=False):
                    for s in () if spans is None else spans:
                        fresh[start + s["start"] : min(start + s["end"] - SHINGLE + 1, end)] = False
                run, low, high = _within(low, high, _unheld(fresh))
                key, place = key[run], place[run]
            text = np.searchsorted(base, place, "right") - 1
            spot = place - base[text] << 12 | place - low << 6 | high - low
            yield pd.DataFrame({"key": signed(key), "doc_id": frame["doc_id"].to_numpy()[at][text], "spot": spot})

    return docs.mapInPandas(rows, "key long, doc_id long, spot long")


def _promising(alone: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Stretches [a, b) of whole windows of one text, in which few are ``alone``; texts begin at ``base``."""
    n = len(alone) - LEAST + 1
    if n < 1:
        return np.empty((0, 2), np.int64)
    total = np.concatenate(([0], np.cumsum(alone)))
    start = np.flatnonzero(total[LEAST:] - total[:n] <= MISSING)
    text = np.searchsorted(base, start, "right") - 1
    inside = start + LEAST <= base[text + 1]
    start, text = start[inside], text[inside]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > start[:-1] + LEAST) | (text[1:] != text[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return np.stack([start[new], start[last] + LEAST], axis=1) if len(start) else np.empty((0, 2), np.int64)


def _unheld(fresh: np.ndarray) -> np.ndarray:
    """Stretches [a, b] of starts whose windows have more than ``MISSING`` fresh tokens."""
    total = np.concatenate(([0], np.cumsum(fresh)))
    many = np.concatenate(([False], total[LEAST:] - total[:-LEAST] > MISSING, [False]))
    edge = np.flatnonzero(many[1:] != many[:-1])
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


def _within(low: np.ndarray, high: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of runs [low, high] that lie in some of the stretches: their run, first and last.

    The fewer starts a row has, the more tokens all of its windows hold, and the fewer others are like these.
    """
    first = np.searchsorted(stretches[:, 1], low)
    count = np.maximum(np.searchsorted(stretches[:, 0], high, "right") - first, 0)
    run = np.repeat(np.arange(len(low)), count)
    at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + first[run]
    return run, np.maximum(low[run], stretches[at, 0]), np.minimum(high[run], stretches[at, 1])


def _copies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeats by texts that are wholly those of an earlier document, as SPANS, and the other texts."""
    digest = F.sha2("text", 256)
    rows = texts.select("doc_id", digest.alias("digest"))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("n")).filter("n > 1")
    found = look_up(rows, saved(groups, "copied"), "digest", "n").filter("doc_id > source_id").drop("n").distinct()
    found = saved(found, "copies")
    ids = found.select("doc_id")
    there = likely(texts, ids, "doc_id").withColumn("digest", digest)
    copied = there.join(found, ["doc_id", "digest"]).select("doc_id", "source_id", word_count(F.col("text")).alias("n"))
    # Saved, or Spark would count the words of all texts to filter them before the join.
    spans = saved(copied.distinct(), "whole").filter(F.col("n") >= WORDS).select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"),
        "source_id", F.lit(0).cast("long").alias("source_start"), F.col("n").alias("source_end"), F.lit(1.0).alias("similarity"),
    )
    others = there.join(found, ["doc_id", "digest"], "left_anti").select(texts.columns)
    return spans, unlikely(texts, ids, "doc_id").unionByName(others)


def _stretches(match: np.ndarray, penalty: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` in which matches, at 1, outweigh the others, at -penalty."""
    out, todo = [], [(0, len(match))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        total = np.concatenate(([0], np.cumsum(np.where(match[low:high], 1, -penalty))))
        floor = np.minimum.accumulate(total)
        end = int(np.argmax(total - floor))
        if total[end] <= floor[end]:
            continue
        start = int(np.flatnonzero(total[: end + 1] == floor[end])[-1])
        if end - start >= least:
            out.append((low + start, low + end))
        todo += [(low, low + start), (low + end, high)]
    return out


def _previous(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where each token was last, or -1; ``order`` sorts them and keeps equal ones in place."""
    out = np.full(len(tokens), -1)
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    out[order[again + 1]] = order[again]
    return out


def _fewest(previous: np.ndarray, size: int) -> int:
    """The fewest distinct tokens in ``size`` in a row."""
    n = len(previous) - size + 1
    if n < 1:
        return 0
    if previous.max() < 0:
        return size
    # A token counts as a repeat in the windows from where it was last back to the first that holds it.
    at = np.flatnonzero(previous >= 0)
    low, high = np.maximum(at - size + 1, 0), np.minimum(previous[at], n - 1)
    inside = low <= high
    steps = np.bincount(low[inside], minlength=n + 1) - np.bincount(high[inside] + 1, minlength=n + 1)
    return size - int(np.cumsum(steps[:n]).max())


def alike(a: np.ndarray, b: np.ndarray, least: int = LEAST, similar: int = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """Stretches [i, j) of tokens a that are like [k, l) of b: (i, j, k, l, similarity)."""
    if len(a) < least or len(b) < least:
        return []
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    at = np.searchsorted(ordered, a)
    at[at == len(b)] = 0
    match = ordered[at] == a
    where = np.where(match, order[at], len(b))  # the first place in b, past its end if there is none
    before = _previous(b, order)
    same = np.arange(len(b))  # the first place of each token of b
    if before.max() >= 0:
        same[order] = order[np.searchsorted(ordered, ordered)]
    earlier = _previous(a, np.argsort(a, kind="stable"))
    fewest = _fewest(before, least)
    held = np.zeros(len(b) + 1, bool)
    out: list[tuple[int, int, int, int, float]] = []

    def possible(spans: np.ndarray) -> np.ndarray:
        """Of stretches, rows (i, j) of a, those but the ones that ``verified`` rejects at once, many at a time."""
        low, high = int(spans[:, 0].min()), int(spans[:, 1].max())
        at = np.arange(low, high)
        inside = (at >= spans[:, :1]) & (at < spans[:, 1:])
        own = inside & match[low:high]
        inside &= earlier[low:high] < spans[:, :1]
        p, both = inside.sum(axis=1), (inside & own).sum(axis=1)
        # A stretch of b has all common tokens at most, and ``fewest`` tokens at least.
        good = np.flatnonzero((both > 0) & (100 * both >= similar * (p + np.maximum(fewest, both) - both)))
        if not len(good):
            return spans[:0]
        own, p, spans = own[good], p[good], spans[good]
        there = where[low:high]
        apart = there - at
        ordered = np.sort(np.where(own, apart, len(a) + len(b)), axis=1)
        shift = ordered[np.arange(len(own)), own.sum(axis=1) // 2]
        near = own & (np.abs(apart - shift[:, None]) <= (spans[:, 1:] - spans[:, :1]) // 4)
        k, l = np.where(near, there, len(b)).min(axis=1), np.where(near, there, -1).max(axis=1) + 1
        begin, end = int(k.min()), int(l.max())
        held = np.zeros((len(own), len(b) + 1), bool)
        row, column = np.nonzero(own)
        held[row, there[column]] = True
        at = np.arange(begin, end)
        first = (before[begin:end] < k[:, None]) & (at >= k[:, None]) & (at < l[:, None])
        q, both = first.sum(axis=1), (first & held[:, same[begin:end]]).sum(axis=1)
        return spans[(l - k < least) | (100 * both >= similar * (p + q - both))]

    def verified(i: int, j: int) -> bool:
        """Accept the stretch if some stretch of b around its matches is like it."""
        own = np.flatnonzero(match[i:j]) + i
        p = int(np.count_nonzero(earlier[i:j] < i))
        if not len(own) or 100 * len(own) < similar * p:
            return False  # as the intersection is no larger, and the union no smaller
        there = where[own]
        apart = there - own
        shift = int(np.sort(apart)[len(apart) // 2])
        near = there[np.abs(apart - shift) <= (j - i) // 4]
        k, l = int(near.min()), int(near.max()) + 1
        held[:] = False
        held[there] = True
        if l - k >= least:
            return accepted(i, j, p, k, l)
        # Tokens that recur are found at their first place only, so all windows around it are tried.
        if accepted(i, j, p, k, min(len(b), k + j - i)):
            return True
        low, high = max(0, l - least), min(k, len(b) - least)
        if low <= high:
            x = np.arange(low, high + 1)
            at = x[:, None] + np.arange(least)
            first = before[at] < x[:, None]  # in its window
            own, both = first.sum(axis=1), (first & held[same[at]]).sum(axis=1)
            good = np.flatnonzero(100 * both >= similar * (p + own - both))
            if len(good):
                x, own, both = int(x[good[0]]), int(own[good[0]]), int(both[good[0]])
                out.append((i, j, x, x + least, both / (p + own - both)))
                return True
        size = min(len(b), max(least, j - i))
        low = min(max(0, i + shift), len(b) - size)
        return accepted(i, j, p, low, low + size)

    def accepted(i: int, j: int, p: int, k: int, l: int) -> bool:
        """Of a stretch with p distinct tokens, those of b ``held``, and a stretch of b."""
        if l - k < least:
            return False
        first = before[k:l] < k
        q = int(np.count_nonzero(first))
        both = int(np.count_nonzero(first & held[same[k:l]]))
        good = 100 * both >= similar * (p + q - both)
        if good:
            out.append((i, j, k, l, both / (p + q - both)))
        return good

    def refine(low: int, high: int, penalties: tuple[int, ...]) -> None:
        """Accept the stretches that verify, and look into the others more strictly."""
        for i, j in _stretches(match[low:high], penalties[0], least):
            if not verified(low + i, low + j) and len(penalties) > 1:
                refine(low + i, low + j, penalties[1:])

    def grow(low: int, high: int) -> None:
        """Accept stretches that need some of the tokens around their matches, the longest first."""
        spans = _grown(match[low:high], least)
        size = max(1, min(64, _PART // (len(a) + len(b))))
        for at in range(0, len(spans), size):
            for i, j in possible(spans[at : at + size] + low).tolist():
                if verified(i, j):
                    grow(low, i)
                    grow(j, high)
                    return

    def wider(span: tuple[int, int, int, int, float], front: bool) -> tuple[int, int, int, int, float]:
        """The stretch with what follows, or is in front, as far as windows of ``least`` tokens have common ones but for a fifth."""
        i, j, k, l, _ = span
        if front:
            starts = np.arange(i - 1, -1, -1)
            lacks = lacking[np.minimum(starts + least, len(a))] - lacking[starts]
        else:
            starts = np.arange(j + 1, len(a) + 1)
            lacks = lacking[starts] - lacking[starts - least]
        far = np.flatnonzero(lacks > least * (100 - similar) // 100)
        n = int(far[0]) if len(far) else len(starts)
        new = (match[i - n : i][::-1] if front else match[j : j + n]).copy()
        new[:-1] &= ~new[1:]  # the last tokens of runs of common ones
        for more in (np.flatnonzero(new) + 1)[::-1].tolist():
            low, high = (i - more, j) if front else (i, j + more)
            there = int(where[low if front else high - 1])
            if abs((there - k) - (low - i) if front else (there + 1 - l) - (high - j)) > least:
                continue
            begin, end = (there, l) if front else (k, there + 1)
            own = match[low:high]
            held[:] = False
            held[where[low:high][own]] = True
            if accepted(low, high, int(np.count_nonzero(earlier[low:high] < low)), begin, end):
                return out.pop()
        return span

    refine(0, len(a), (3, 6, 12, 1 << 30))
    edges = [0, *(x for i, j, *_ in sorted(out) for x in (i, j)), len(a)]
    for low, high in zip(edges[::2], edges[1::2]):
        grow(low, high)
    lacking = np.concatenate(([0], np.cumsum(~match)))
    return [wider(wider(x, False), True) for x in out.copy()]


def _grown(match: np.ndarray, least: int) -> np.ndarray:
    """Stretches of at least ``least`` that may be like others, matches at their ends if they can be.

    Of n tokens each, m of them common, m / (2 n - m) is 0.8 where 1 for a match and -8 for
    another token add up to 0. A word more or less in the other stretch allows 4 below that, and
    tokens that recur make as little as 1 to -4 enough. From each start the longest is taken.
    They are rows (start, end), the longest first.
    """
    n, none = len(match), np.empty((0, 2), np.int64)
    if n < least or 100 * int(np.count_nonzero(match)) < SIMILAR * least // 2:
        return none
    total = np.concatenate(([0], np.cumsum(match)))
    if 100 * int((total[least:] - total[:-least]).max()) < (SIMILAR - 10) * least:
        return none  # tokens that recur leave room for 10 per cent
    left = np.flatnonzero(match)
    found = []
    for penalty, belows in ((8, (0, 4, 8)), (6, (0,)), (4, (0,))):
        score = np.concatenate(([0], np.cumsum(np.where(match, 1, -penalty))))
        best = np.maximum.accumulate(score[::-1])[::-1]  # of the ends from here on; it falls
        for below in belows:
            end = np.searchsorted(-best, below - score, "right") - 1
            i = np.flatnonzero(end - np.arange(n + 1) >= least)
            j = end[i]
            some = total[j] > total[i]
            first, last = left[total[i[some]]], left[total[j[some]] - 1]
            i[some] = np.minimum(first, j[some] - least)
            j[some] = np.maximum(last + 1, i[some] + least)
            found.append(i * (n + 1) + j)
    i, j = np.divmod(np.unique(np.concatenate(found)), n + 1)
    longest = np.argsort(i - j, kind="stable")
    return np.stack([i[longest], j[longest]], axis=1)


def _clusters(places: list[tuple[int, int]], least: int) -> list[list[tuple[int, int]]]:
    """Pairs of places on nearly one diagonal, none far from the one before."""
    open_: list[list[tuple[int, int]]] = []
    done = []
    for a, b in sorted(set(places)):
        for c in open_:
            if a - c[-1][0] <= 2 * least and abs((a - b) - (c[-1][0] - c[-1][1])) <= least // 2:
                c.append((a, b))
                break
        else:
            open_.append([(a, b)])
        if len(open_) > 64:
            done, open_ = done + [c for c in open_ if a - c[-1][0] > 2 * least], [c for c in open_ if a - c[-1][0] <= 2 * least]
    return done + open_


def _by_documents(pairs: DataFrame) -> DataFrame:
    """The places of pairs (doc_id, place, source_id, source_place), a row for two documents."""
    grouped = pairs.groupBy("doc_id", "source_id").agg(F.collect_list(F.struct("place", "source_place")).alias("places"))
    return saved(grouped, "pairs")


def _verified(grouped: DataFrame, docs: DataFrame, around: tuple[int, ...] = (LEAST, WIDE)) -> DataFrame:
    """The repeats among pairs ``_by_documents``, as SPANS.

    The tokens up to so many before and behind their places are compared: few show what is alike at a place by
    itself, more what is alike with the help of what lies beside it.
    """
    ids = grouped.select(F.explode(F.array("doc_id", "source_id")).alias("id")).distinct()
    texts = saved(likely(docs, ids, "doc_id").join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "texts")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens = None, None
        for f in frames:
            out = []
            for doc_id, source_id, own, there, text in zip(*(f[c] for c in ("doc_id", "source_id", "place", "source_place", "source_text")), strict=True):
                if source_id != last:
                    last, tokens = source_id, shingles(next(iter(word_hashes([text]))))
                for c in _clusters(list(zip(own.tolist(), there.tolist(), strict=True)), LEAST):
                    low, high = min(b for _, b in c), max(b for _, b in c)
                    held = signed(tokens[max(0, low - max(around)) : high + max(around)])
                    out.append((doc_id, source_id, min(a for a, _ in c), max(a for a, _ in c), low, high, held))
            yield pd.DataFrame(out, columns=["doc_id", "source_id", "first", "last", "low", "high", "tokens"])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens = None, None
        for f in frames:
            out = []
            for doc_id, source_id, first, end, low, high, held, text in zip(*(f[c] for c in ("doc_id", "source_id", "first", "last", "low", "high", "tokens", "text")), strict=True):
                if doc_id != last:
                    last, tokens = doc_id, shingles(next(iter(word_hashes([text]))))
                held, begin = np.asarray(held, np.int64).view(np.uint64), max(0, low - max(around))
                for n in around:
                    own, there = max(0, first - n), max(0, low - n)
                    out += _spans(doc_id, source_id, own, there, tokens[own : end + n], held[there - begin : high + n - begin])
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SPANS.split(", ")])

    source = texts.select(F.col("doc_id").alias("source_id"), F.col("text").alias("source_text"))
    pieces = grouped.join(source, "source_id").select("doc_id", "source_id", "places.place", "places.source_place", "source_text").mapInPandas(
        cut, "doc_id long, source_id long, first long, last long, low long, high long, tokens array<long>"
    )
    return pieces.join(texts.select("doc_id", "text"), "doc_id").mapInPandas(compare, SPANS)


def _spans(doc_id: int, source_id: int, base: int, low: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """The repeats between two stretches that begin at tokens base and low, in words."""
    more = SHINGLE - 1
    return [(doc_id, base + i, base + j + more, source_id, low + k, low + l + more, s) for i, j, k, l, s in alike(a, b)]


def _around(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each place, the ``_REACH`` tokens that windows with it can hold, as 16 bits each.

    14 bits are the token's. ``_AGAIN`` says that the row had the token before, ``_EVER`` that each stretch of
    ``LEAST`` tokens of the row has it (the first of them is marked), and both that the text has no such place.
    """
    previous = _previous(tokens, np.argsort(tokens, kind="stable"))
    again = np.flatnonzero(previous >= 0)
    back, ahead = (np.full(len(tokens) + _REACH - 1, _REACH, np.uint8) for _ in range(2))  # to the same token
    apart = np.minimum(again - previous[again], _REACH).astype(np.uint8)
    back[again + LEAST - 1] = apart
    ahead[previous[again] + LEAST - 1] = apart
    padded = np.full(len(tokens) + _REACH - 1, _AGAIN | _EVER, np.uint16)
    padded[LEAST - 1 : LEAST - 1 + len(tokens)] = tokens & np.uint64(_TOKEN)
    out = sliding_window_view(padded, _REACH)[place]
    out[sliding_window_view(back, _REACH)[place] <= _AT.astype(np.uint8)] |= _AGAIN
    low = np.maximum(LEAST - 1 - place, 0)
    high = np.minimum(len(tokens) + LEAST - 1 - place, _REACH)
    first = (out < _AGAIN) & (_AT < low[:, None] + LEAST)
    out[first & (_AT >= high[:, None] - LEAST)] |= _EVER
    if len(apart) and apart.min() <= LEAST:
        row, column = np.nonzero(first & (out < _AGAIN) & (sliding_window_view(ahead, _REACH)[place] <= LEAST))
        now = column
        while len(row):
            now = now + ahead[place[row] + now]
            inside = now >= high[row] - LEAST
            out[row[inside], column[inside]] |= _EVER
            near = ~inside & (ahead[place[row] + now] <= LEAST)
            row, column, now = row[near], column[near], now[near]
    return out


def _signed(doc_id: int, tokens: np.ndarray, key, spot, asks, asking, blocks) -> pd.DataFrame:
    """A document's rows with the tokens around them; of those that do not ask and are the same, the first."""
    inside = spot >> 12 < len(tokens)  # others are of another text with this id
    key, spot, asks, asking, blocks = (np.asarray(x)[inside] for x in (key, spot, asks, asking, blocks))
    asks = asks.astype(bool)
    place, first = spot >> 12, (spot >> 12) - (spot >> 6 & 63)
    last = first + (spot & 63)
    at, inverse = np.unique(place, return_inverse=True)
    around = _around(tokens, at)
    same = _content(around)[inverse]
    order = np.lexsort((place, same, key, asks))
    new = np.ones(len(order), bool)
    new[1:] = asks[order[1:]] | (key[order[1:]] != key[order[:-1]]) | (same[order[1:]] != same[order[:-1]])
    some = order[new]
    held = [x.tobytes() for x in around]
    columns = {"key": key, "asks": asks, "asking": asking, "blocks": blocks, "place": place, "first": first, "last": last, "same": signed(same)}
    return pd.DataFrame({"doc_id": doc_id, **{c: x[some] for c, x in columns.items()}, "around": [held[k] for k in inverse[some].tolist()]})


def _content(around: np.ndarray) -> np.ndarray:
    """A hash of each row of tokens."""
    return mix((around.astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64))


def _candidates(asking: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of rows ``asking`` (key, doc_id, spot, n) and earlier documents' rows of their key that may be alike.

    Blocks of a key's rows meet, each row with the tokens around its place. Of windows that are alike the
    first miss at most ``MISSING`` tokens, and the second have most in common, so no pair is left out.
    """
    asked = asking.groupBy("key").agg(
        F.ceil(F.count("*") / BLOCK).alias("asking"), F.ceil(F.max("n") / BLOCK).alias("blocks")
    )
    asked = saved(asked, "asked")
    there = likely(rows, asked.select("key"), "key").withColumn("asks", F.lit(False))
    either = asking.select("key", "doc_id", "spot", F.lit(True).alias("asks")).unionByName(there)
    # A document has rows in proportion to its text.
    held = either.join(asked, "key").groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "spot", "asks", "asking", "blocks")).alias("rows")
    )
    held = saved(held, "compared")
    texts = likely(docs, held.select("doc_id"), "doc_id").join(held, "doc_id")
    names = ["key", "small", "large"]

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, n = [], 0
            for at, words in enumerate(word_hashes(frame["text"])):
                out.append(_signed(frame["doc_id"].iloc[at], shingles(words), *(frame[c].iloc[at] for c in fields)))
                n += len(out[-1])
                if n > 10_000:
                    yield pd.concat(out, ignore_index=True)
                    out, n = [], 0
            if n:
                yield pd.concat(out, ignore_index=True)

    fields = ["key", "spot", "asks", "asking", "blocks"]
    signatures = texts.select("doc_id", "text", *(f"rows.{c}" for c in fields)).mapInPandas(
        sign, "doc_id long, key long, asks boolean, asking long, blocks long, place long, first long, last long, same long, around binary"
    )
    # Each block of asking rows of a key meets each block of all its rows.
    at = F.xxhash64("doc_id", "place", "first")
    own = F.when(F.col("asks"), F.pmod(at, F.col("asking"))).otherwise(F.pmod(at, F.col("blocks")))
    others = F.when(F.col("asks"), F.col("blocks")).otherwise(F.col("asking"))
    placed = (
        signatures.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        .withColumn("small", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")))
        .withColumn("large", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")))
        .select(*names, "asks", "doc_id", "place", "first", "last", "same", "around")
    )

    columns = [x.split()[0] for x in _CANDIDATES.split(", ")]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks, group in whole_groups(frames, names, _ROWS):
            for found in _alike_rows(blocks, group):
                yield pd.DataFrame(found, columns=columns)

    return placed.repartition(*names).sortWithinPartitions(*names).mapInPandas(compare, _CANDIDATES)


def _alike_rows(f: dict[str, np.ndarray], group: np.ndarray) -> Iterator[np.ndarray]:
    """Rows that ask, each with the rows of earlier documents of its group that may be alike.

    Bitmaps tell most of the others apart; of the rest, the tokens decide. Groups are numbered in order.
    """
    asks = f["asks"].astype(bool)
    tokens = np.frombuffer(b"".join(f["around"]), np.uint16).reshape(-1, _REACH)
    # Rows in order of group and document, those that ask before the others of their document.
    order = np.lexsort((~asks, f["doc_id"], group))
    there, own = order[~asks[order]], order[asks[order]]
    end = np.cumsum(~asks[order])[asks[order]]
    start = np.searchsorted(group[there], group[own])
    own, start, end = (x[end > start] for x in (own, start, end))
    if not len(own):
        return
    # Rows that ask the same are compared once: each but the first is a copy of the one that ``one`` names.
    begin, until = (f[c] - f["place"] + LEAST - 1 for c in ("first", "last"))
    question = np.stack([group[own], f["doc_id"][own], f["same"][own], begin[own], until[own]])
    alike = np.lexsort(question[::-1])
    new = np.ones(len(own), bool)
    new[1:] = (question[:, alike[1:]] != question[:, alike[:-1]]).any(axis=0)
    copies, edges = own[alike], np.append(np.flatnonzero(new), len(own))
    own, start, end = (x[alike[new]] for x in (own, start, end))
    begin, until = begin[own], until[own]
    held, around = _sketches(tokens[there]), _sketches(tokens[own])
    core = (_AT >= until[:, None]) & (_AT < begin[:, None] + LEAST)
    core = _sketches(np.where(core, tokens[own], _AGAIN | _EVER))
    # On fewer bits shingles may collide.
    few = np.minimum(LEAST, np.bitwise_count(around).sum(axis=1)) * SIMILAR / 100 * 0.85
    total = np.concatenate(([0], np.cumsum(end - start)))
    low = 0
    while low < len(own):
        high = max(low + 1, min(low + _ASKING, int(np.searchsorted(total, total[low] + _PAIRS, "right")) - 1))
        for at in range(0, int(total[high] - total[low]), _PAIRS):
            pair = np.arange(total[low] + at, min(total[high], total[low] + at + _PAIRS))
            x = np.searchsorted(total, pair, "right") - 1
            y = start[x] + pair - total[x]
            near = np.bitwise_count(~held[y] & core[x]).sum(axis=1) <= MISSING
            near[near] = np.bitwise_count(held[y[near]] & around[x[near]]).sum(axis=1) >= few[x[near]]
            x, y = x[near], y[near]
            if not len(x):
                continue
            missing, score = _compared(tokens[own[low:high]], x - low, tokens[there[y]], begin[x], until[x])
            good = (missing <= MISSING) & (score >= 0)
            x, y, missing = x[good], there[y[good]], missing[good]
            if not len(x):
                continue
            # Of each other document the place most like it.
            best = np.lexsort((f["place"][y], missing, f["doc_id"][y], x))
            x, y, missing = x[best], y[best], missing[best]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (f["doc_id"][y[1:]] != f["doc_id"][y[:-1]])
            x, y, missing = x[new], y[new], missing[new]
            count = edges[x + 1] - edges[x]
            each = copies[np.repeat(edges[x], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            y, missing = np.repeat(y, count), np.repeat(missing, count)
            yield np.column_stack([*(f[c][each] for c in ("doc_id", "place", "first", "last")), f["doc_id"][y], f["place"][y], missing])
        low = high


def _sketches(rows: np.ndarray) -> np.ndarray:
    """A bitmap of the tokens of each row ``_around``."""
    out = np.zeros((len(rows), _SKETCH + 1), bool)
    out[np.arange(len(rows))[:, None], np.where(rows >= _AGAIN | _EVER, _SKETCH, rows & (_SKETCH - 1))] = True
    return np.packbits(out[:, :_SKETCH], axis=1).view(np.uint64)


def _compared(asking: np.ndarray, x: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of row x of ``asking`` and one of ``rows``, both ``_around``: tokens lacking, and a bound on likeness.

    Lacking are those of the window of ``asking`` with the fewest such, of windows that begin at first to last.
    The bound is under 0 only if no stretch of the one is like one of the other: stretches of ``LEAST`` tokens and
    more are alike if 4 times the tokens that one of them lacks are not more than the common ones.
    """
    mine = asking < _AGAIN | _EVER
    token = np.where(mine, asking & _TOKEN, _TOKEN + 1)
    where = np.full((len(asking), _TOKEN + 2), _REACH, np.uint8)
    np.put_along_axis(where, token, _AT.astype(np.uint8)[None], axis=1)
    where[:, -1] = _REACH
    there = np.zeros((len(rows), _REACH + 1), bool)
    column = where[x[:, None], np.where(rows < _AGAIN | _EVER, rows & _TOKEN, _TOKEN + 1)]
    np.put_along_axis(there, column.astype(np.int64), True, axis=1)
    there[:, _REACH] = False
    hit = np.take_along_axis(there, np.take_along_axis(where, token, axis=1).astype(np.int64)[x], axis=1)
    lacks = _lacking(asking[x], hit)
    held = _lacking(rows, column < _REACH).min(axis=1)
    score, half = _likeness(asking[x], hit, last + MISSING, first + LEAST - MISSING)
    other, other_half = _likeness(rows, column < _REACH)
    # Neither stretch has more common tokens than the other, and each lacks as many as some window of it.
    score = np.minimum(score + other, np.minimum(half - 4 * held, other_half - 4 * lacks.min(axis=1)))
    lacks[(_AT[:LEAST] < first[:, None]) | (_AT[:LEAST] > last[:, None])] = _REACH
    return lacks.min(axis=1), score


def _lacking(rows: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Of each window of ``LEAST`` tokens, no more than the distinct ones it does not share."""
    total = np.zeros((len(rows), _REACH + 1), np.int16)
    np.cumsum(~hit & (rows & _AGAIN == 0), axis=1, out=total[:, 1:])
    lacks = total[:, LEAST:] - total[:, :-LEAST]
    outside = np.zeros((len(rows), _REACH + 1), np.int16)
    np.cumsum(rows >= _AGAIN | _EVER, axis=1, out=outside[:, 1:])
    lacks[outside[:, LEAST:] > outside[:, :-LEAST]] = _REACH
    return lacks


def _likeness(rows: np.ndarray, hit: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> list[np.ndarray]:
    """No less than the tokens that any stretch of ``LEAST`` and more of a row shares, less 8, and 4, times those it does not.

    With ``first`` and ``last``, stretches that begin at ``first`` or before and end at ``last`` or after, at
    common tokens where they are longer than ``LEAST``: others explain no window that asks. Common tokens
    count wherever they are, others only the first time. All stretches have the tokens that are marked so,
    and no more distinct ones than the row.
    """
    new = rows & _AGAIN == 0
    pads = rows >= _AGAIN | _EVER
    common = np.count_nonzero(hit & new, axis=1)
    ever = np.count_nonzero(~hit & new & (rows >= _EVER), axis=1)
    if first is not None:
        starts, ends = _AT[:LEAST] <= first[:, None], _AT[:LEAST] >= last[:, None] - LEAST
        whole, begins, closes = starts & ends, hit[:, :LEAST], hit[:, LEAST - 1 :]
        # One that lacks a token at an end, where the next at the other is common, is no passage: that beside it is.
        whole[:, :-1] &= begins[:, :-1] | ~hit[:, LEAST:]
        whole[:, 1:] &= closes[:, 1:] | ~hit[:, : LEAST - 1]
        starts, ends = starts & begins, ends & closes
    out = []
    for times in (8, 4):
        step = np.where(hit, np.int8(1), np.where(new, np.int8(-times), np.int8(0)))
        step[pads] = -_REACH - 1
        score = np.zeros((len(rows), _REACH + 1), np.int16)
        np.cumsum(step, axis=1, out=score[:, 1:])
        low, high = score[:, :-LEAST], score[:, LEAST:]
        if first is None:
            best = (high - np.minimum.accumulate(low, axis=1)).max(axis=1)
        else:
            least = np.where(whole, high - low, _NONE).max(axis=1)
            low, high = np.where(starts, low, -_NONE), np.where(ends, high, _NONE)
            best = np.maximum(least, (high - np.minimum.accumulate(low, axis=1)).max(axis=1))
        out.append(np.minimum(best, common - times * ever))
    return out


def _unexplained(asking: DataFrame, rows: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The repeats by rows ``asking`` (key, doc_id, spot, n) of any of the n rows of their key, as SPANS.

    Each row that asks is verified with the row most like it; those that no passage found then holds
    are verified with all other documents, each at the place most like it.
    """
    # The first row of a key has been compared before.
    alike_rows = saved(_candidates(asking.filter("n > 2"), rows, docs), "candidates")
    least = F.min(F.struct("missing", "source_id", "source_place")).alias("best")
    best = alike_rows.groupBy("doc_id", "place", "first", "last").agg(least)
    pairs = best.select("doc_id", "place", "best.source_id", "best.source_place").distinct()
    more = saved(_verified(_by_documents(pairs), docs), "repeats")
    found = spans.unionByName(more).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    inside = F.exists(
        "found", lambda s: (s["start"] <= F.col("first") + MISSING) & (s["end"] >= F.col("last") + WORDS - MISSING)
    )
    rest = alike_rows.join(found, "doc_id", "left").filter(F.col("found").isNull() | ~inside)
    place = F.min(F.struct("missing", "source_place"))["source_place"].alias("source_place")
    rest = rest.groupBy("doc_id", "place", "first", "last", "source_id").agg(place).select(pairs.columns).distinct()
    last = _verified(_by_documents(rest.join(pairs, pairs.columns, "left_anti")), docs)
    return more.unionByName(saved(last, "repeats"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Repeats of earlier passages: doc_id, start, end, source_id, source_start, source_end, similarity.

    Places are words, ends exclusive; words are as in ``words``. A passage of at least 50 words
    is listed, with one earlier passage it repeats, if the similarity of their shingle sets is
    at least 0.8; earlier means in a document with a smaller doc_id. Passages may overlap. Texts that are null, empty or shorter have none, and rows
    without a doc_id are left out. Repeated rows are one document; one id with several texts
    has the passages of each. No documents give no rows; other columns are ignored.
    """
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies, texts = _copies(texts)
    recurring = docs.sparkSession.sparkContext.broadcast(_recurring(texts))
    rows = saved(_windows(texts, recurring), "windows")
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "spot")).alias("source"), F.count("*").alias("n"))
    first = saved(first.filter("n > 1").select("key", F.col("source.doc_id").alias("source_id"), F.col("source.spot").alias("source_spot"), "n"), "first")
    place = [F.shiftright("spot", 12).alias("place"), F.shiftright("source_spot", 12).alias("source_place")]
    # A key is there once, so a hash table of them spares a sort of the rows.
    first = first.hint("shuffle_hash")
    pairs = _by_documents(rows.join(first, "key").filter("doc_id <> source_id").select("doc_id", "source_id", *place))
    spans = saved(_verified(pairs, texts, (LEAST,)), "repeats")
    found = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    # The first document of a key has nothing to repeat.
    later = saved(pairs.filter("doc_id > source_id").select("doc_id").distinct(), "later")
    there = likely(texts, later, "doc_id").join(later, "doc_id", "left_semi")
    asking = _windows(there.join(found, "doc_id", "left"), recurring, rest=True)
    asking = saved(asking.join(first, "key").filter("doc_id > source_id").select("key", "doc_id", "spot", "n"), "asking")
    more = _unexplained(asking, rows, texts, spans)
    return spans.unionByName(more).unionByName(copies).groupBy("doc_id", "start", "end").agg(
        F.min(F.struct("source_id", "source_start", "source_end", "similarity")).alias("s")
    ).select("doc_id", "start", "end", "s.*")


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; other texts stay as they are.

    Rows without passages, null texts included, do not change. A cut reaches from its first word
    up to the word after its last, or to the end of the text. ``n_chars``, where there is
    such a column, follows.
    """
    spans = saved(
        passages.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.collect_set(F.struct("start", "end")).alias("__cuts")),
        "cuts",
    )
    ids = spans.select("__id")

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, c) for t, c in zip(text, cuts, strict=True)], dtype=object)

    own = F.col("doc_id") == F.col("__id")
    there = likely(docs, ids, "doc_id")
    # Saved, as texts then go to Python a few megabytes at a time, whoever writes the result.
    text = cut("text", "__cuts").alias("text")
    changed = there.filter("text is not null").join(spans, own).select(*(text if c == "text" else c for c in docs.columns))
    changed = saved(changed, "cut")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    same = there.join(ids, own & F.col("text").isNotNull(), "left_anti")
    return unlikely(docs, ids, "doc_id").unionByName(same).unionByName(changed.select(*docs.columns))


def _cut(text: str | None, cuts) -> str | None:
    if text is None or cuts is None or not len(cuts):
        return text
    data = text.encode("utf-8", "surrogatepass")
    _, start, _ = word_spans(text)
    out, at = [], 0
    for first, end in sorted((c["start"], c["end"]) for c in cuts):
        if first >= len(start):
            continue
        low = max(at, int(start[first]))
        out.append(data[at:low])
        at = max(at, int(start[end]) if end < len(start) else len(data))
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
