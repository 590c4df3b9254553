"""Score whole documents by a recurrent language model learnt from the others.

1. The words of all training documents are counted. The most frequent, at most ``FREQUENT``,
   go to every task with their counts; the first ``VOCABULARY`` of them are the model's words.
2. The model (see ``gru``) learns from all of every training document, in segments of
   ``SEGMENT`` words. Each task trains its own copy on what it reads; the copies are averaged,
   weighted by words.
3. One pass over all texts scores them with the state carried from window to window, so over
   whole documents. A word outside the vocabulary gets its class's probability times its
   smoothed frequency among such words. Words that are not frequent are joined with the counts.

The probability of a text is then the product over its words and its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import gru
from sluiceway.llm.tables import saved
from sluiceway.llm.words import signed, word_hashes

FREQUENT = 1 << 17
VOCABULARY = 1 << 12
SEGMENT = 128
ROUNDS = 1
END = np.uint64(0x1D)  # stands for the end of a text
_FLUSH = 3_000_000
_PIECE = 1 << 14
_LOWER_BITS = np.uint64(46)


class Known(NamedTuple):
    """What every task knows of the words: frequent ones, sorted, and the totals of all."""

    words: np.ndarray
    counts: np.ndarray
    number: np.ndarray  # in the vocabulary, or -1
    tokens: int
    distinct: int
    vocabulary: np.ndarray  # the counts of its words
    other_tokens: int
    other_distinct: int
    starts: np.ndarray  # how many of the frequent words are less than each value of the upper bits

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words are among the frequent ones, and whether they are.

        Words are hashes, so few share their upper bits, and from the first of these it is a step or two.
        """
        last = len(self.words) - 1
        at = np.minimum(np.take(self.starts, (words >> _LOWER_BITS).astype(np.int64)), last)
        held = np.take(self.words, at)
        less = np.flatnonzero((held < words) & (at < last))
        while len(less):
            at[less] += 1
            held[less] = now = self.words[at[less]]
            less = less[(now < words[less]) & (at[less] < last)]
        return at, held == words

    def numbers(self, words: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The words as the model's inputs; ``found`` is what ``find`` said of them."""
        at, there = found or self.find(words)
        number = np.where(there, self.number[at], -1)
        other = len(self.vocabulary) + (words % np.uint64(gru.BUCKETS)).astype(np.int64)
        return np.where(number >= 0, number, other).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learnt from: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(texts) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield np.append(words, END)


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word, and the end, occurs in all texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for words in _tokens(frame["text"]):
                held.append(words)
                size += len(words)
                if size > _FLUSH:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    parts = docs.select("text").mapInPandas(count, "word long, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    words, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"word": signed(words), "n": n})


def know(counts: DataFrame, frequent: int = FREQUENT, vocabulary: int = VOCABULARY) -> Known:
    """The totals of a saved table of counts and its most frequent words.

    Words are taken down to a count at which they are no more than ``frequent``; a histogram
    of the counts, eight steps to a doubling, finds it.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    steps = sorted(steps.collect(), reverse=True)  # at most 8 * 63 rows
    tokens, distinct = sum(s["n"] for s in steps), sum(s["words"] for s in steps)
    total, least = 0, 1 << 20
    for s in steps:
        total += s["words"]
        if total > frequent:
            break
        least = s["level"]
    end = int(signed(np.array([END]))[0])
    table = counts.filter((level >= least) | (F.col("word") == end)).toArrow()  # at most ``frequent`` + 1 rows
    words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    if END not in words:
        words, n = np.append(words, END), np.append(n, 0)
    order = np.argsort(words)
    words, n = words[order], n[order]
    # By count; the end comes first, whatever its count.
    rank = np.lexsort((words, -n, words != END))[:vocabulary]
    number = np.full(len(words), -1)
    number[rank] = np.arange(len(rank))
    chosen = n[rank]
    starts = np.searchsorted(words >> _LOWER_BITS, np.arange(1 << 64 - int(_LOWER_BITS), dtype=np.uint64))
    return Known(words, n, number, tokens, distinct, chosen, tokens - int(chosen.sum()), distinct - int((chosen > 0).sum()), starts)


def _segments(words: np.ndarray) -> list[np.ndarray]:
    """The parts of a text that the model learns from: all of it."""
    return [words[k : k + SEGMENT] for k in range(0, len(words), SEGMENT)]


def train(docs: DataFrame, known: Known, rounds: int = ROUNDS) -> gru.Model:
    """The model learnt from all ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    model = gru.Model.first(known.vocabulary, known.other_tokens)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((known, model.vector))

        def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, vector = shared.value
            own = gru.Model(len(known.vocabulary), vector=vector.copy())
            adagrad = gru.Adagrad(own)
            start = int(known.numbers(np.array([END]))[0])
            held, size, seen = [], 0, 0

            def flush() -> None:
                tokens = known.numbers(np.concatenate(held))
                sizes = np.array([len(x) for x in held])
                gru.run(own, tokens, sizes, start=start, learn=adagrad, streams=256)

            for frame in frames:
                for words in _tokens(frame["text"]):
                    held += _segments(words)
                    size += len(words)
                    if size > _FLUSH // 8:
                        flush()
                        held, size, seen = [], 0, seen + size
            if held:
                flush()
            if seen + size:
                for k in range(0, len(own.vector), _PIECE):
                    yield pd.DataFrame({"piece": [k // _PIECE], "weight": [float(seen + size)], "numbers": [own.vector[k : k + _PIECE]]})

        def combine(f: pd.DataFrame) -> pd.DataFrame:
            weight = f["weight"].to_numpy()
            mean = np.average(np.stack(f["numbers"].to_list()), axis=0, weights=weight).astype(np.float32)
            return pd.DataFrame({"piece": f["piece"][:1], "weight": [weight.sum()], "numbers": [mean]})

        schema = "piece int, weight double, numbers array<float>"
        copies = docs.filter("doc_id is not null").select("text").mapInPandas(learn, schema)
        # In two steps, so that no task holds the copies of all tasks.
        salted = copies.withColumn("salt", F.pmod(F.hash("weight"), F.lit(64)))
        some = salted.groupBy("piece", "salt").applyInPandas(combine, schema)
        pieces = sorted(some.groupBy("piece").applyInPandas(combine, schema).collect())  # one model
        if pieces:
            model = gru.Model(len(known.vocabulary), vector=np.concatenate([np.array(p["numbers"], np.float32) for p in pieces]))
    return model


def score(docs: DataFrame, *, out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``out`` says which documents are not learnt from (``held_out`` of their id, by default). A
    null text is an empty one: a single token, its end. Repeated rows count and are scored
    each. A row without a doc_id counts, but no segment of it trains. Without training
    documents all words are equally unknown. An empty table gives no rows; other columns are
    ignored.
    """
    out = held_out(F.col("doc_id")) if out is None else out
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out"))
    learnt = every.filter(~F.col("held_out"))
    counts = saved(count_words(learnt), "word-counts")
    known = know(counts)
    model = train(learnt, known)
    shared = docs.sparkSession.sparkContext.broadcast((known, model.vector))
    columns = ["row", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "n_rare", "n_other", "base", "other", "log"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, vector = shared.value
        own = gru.Model(len(known.vocabulary), vector=vector.copy())
        start = int(known.numbers(np.array([END]))[0])
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            words = [h[3] for h in held]
            sizes = np.array([len(w) for w in words])
            every = np.concatenate(words)
            text = np.repeat(np.arange(len(held)), sizes)
            at, there = known.find(every)
            inside = there & (known.number[at] >= 0)
            logs = np.where(there, np.log10(known.counts[at] + 1.0), 0.0)
            total = lambda x: np.bincount(text, x, len(held))
            row = np.array([h[0] for h in held], np.int64)
            yield pd.DataFrame(
                {
                    "row": row,
                    "doc_id": pd.array([h[1] for h in held], "Int64"),
                    "held_out": [h[2] for h in held],
                    "word": pd.array([None] * len(held), "Int64"),
                    "times": 0,
                    "n_tokens": sizes,
                    "n_known": total(there & (known.counts[at] > 0)).astype(np.int64),
                    "n_rare": total(~there).astype(np.int64),
                    "n_other": total(~inside).astype(np.int64),
                    "base": total(logs),
                    "other": total(np.where(inside, 0.0, logs)),
                    "log": gru.run(own, known.numbers(every, (at, there)), sizes, start=start) / math.log(10),
                }
            )[columns]
            rare_text, rare_word = text[~there], every[~there]
            order = np.lexsort((rare_word, rare_text))
            rare_text, rare_word = rare_text[order], rare_word[order]
            new = np.ones(len(order), bool)
            new[1:] = (rare_text[1:] != rare_text[:-1]) | (rare_word[1:] != rare_word[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            rare = pd.DataFrame({"row": row[rare_text[first]], "word": signed(rare_word[first]), "times": times})
            yield rare.assign(doc_id=None, held_out=False, n_tokens=0, n_known=0, n_rare=0, n_other=0, base=0.0, other=0.0, log=0.0)[columns]

        for frame in frames:
            ids = frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None)
            for row, doc_id, flag, words in zip(frame["row"], ids, frame["held_out"], _tokens(frame["text"]), strict=True):
                held.append((row, doc_id, flag, words))
                size += len(words)
                if size > _FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    kinds = "row long, doc_id long, held_out boolean, word long, times long, n_tokens long, n_known long, n_rare long, n_other long, base double, other double, log double"
    read_once = saved(every.withColumn("row", F.monotonically_increasing_id()).mapInPandas(read, kinds), "read")
    rare = read_once.filter("times > 0").select("row", "word", "times").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    rows = read_once.filter("times = 0").drop("word", "times").join(rare, "row", "left")
    found = F.coalesce("rare", F.lit(0.0))
    each = math.log10(known.tokens + known.distinct + 1)
    each_other = math.log10(known.other_tokens + known.other_distinct + 1)
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + found - F.col("n_tokens") * each).alias("base_score"),
        (F.col("log") + F.col("other") + found - F.col("n_other") * each_other).alias("score"),
    )
