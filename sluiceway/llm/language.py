"""Language identification by Bayesian fusion of text and metadata.

The posterior of a language is its prior on the item's host, times the likelihoods of the text,
of the declared markup language and of the address suffix.

* Text: naive Bayes over hashed byte trigrams of the letters, counted over all labelled texts
  and tempered, as neighbouring trigrams overlap. The table has ``GRAMS`` rows whatever the input.
* Declared language and suffix: how often each comes with texts that look like a language.
* Host: the languages its texts look like, without the item itself, drawn towards those of its
  domain and, further up, of all items, by ``WEIGHT`` pseudo-counts each.

The last two come from the text-only posteriors by grouped aggregation: sums per value, which
tasks combine before the shuffle. Each item then looks its values up; values with a thousandth
of all items are broadcast, so no task holds a hot host's items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.tables import look_up, saved

LANGUAGES = ("de", "en", "es", "fr")
GRAMS = 1 << 15
TEMPER = 3.0
WEIGHT = 10.0
CONFIDENT = 0.5
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> np.ndarray:
    """Row numbers of a text's trigrams: lower case, anything but letters as one space."""
    raw = _LETTER[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    gram = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)
    return (gram >> np.uint32(17)).astype(np.int64)


def fit(labelled: DataFrame, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Log-probabilities, GRAMS by languages, of trigrams in all texts labelled with each.

    ``labelled`` has text and lang; other languages and null texts are ignored. A language
    without texts has the same probability for all trigrams.
    """
    place = {name: k for k, name in enumerate(languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(place), GRAMS), np.int64)
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                n[place[lang]] += np.bincount(trigrams(text), minlength=GRAMS)
        at = np.nonzero(n)
        yield pd.DataFrame({"cell": at[0] * GRAMS + at[1], "n": n[at]})

    some = labelled.filter(F.col("lang").isin(*languages) & F.col("text").isNotNull()).select("text", "lang")
    cells = some.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.full(len(place) * GRAMS, 0.5)
    n[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    n = n.reshape(len(place), GRAMS)
    return np.log(n / n.sum(axis=1, keepdims=True)).T.copy()


def _softmax(scores: np.ndarray) -> np.ndarray:
    raw = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raw / raw.sum(axis=-1, keepdims=True)


def _read(table) -> Column:
    """Per text: tempered log-likelihood of each language, posterior by these alone, trigrams."""

    @F.pandas_udf("logs array<double>, alone array<double>, grams long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logs, grams = [], []
            for text in batch:
                found = trigrams(text)
                logs.append(table.value[found].sum(axis=0) / TEMPER)
                grams.append(len(found))
            yield pd.DataFrame({"logs": logs, "alone": [_softmax(x) for x in logs], "grams": grams})

    return read(F.col("text"))


def _fused(prior: list[float], weight: float) -> Column:
    """Posterior of each language from all evidence; a null column is none."""

    @F.pandas_udf("array<double>")
    def fuse(
        logs: pd.Series, alone: pd.Series, declared: pd.Series, suffix: pd.Series, sums: pd.Series, drawn: pd.Series, items: pd.Series
    ) -> pd.Series:
        none = np.zeros(len(prior))

        def held(column: pd.Series) -> np.ndarray:
            return np.stack([none if x is None else np.asarray(x, float) for x in column]).reshape(-1, len(prior))

        known = items.notna().to_numpy()
        others = held(sums) - held(alone) + weight * held(drawn)
        on_host = others / (items.fillna(1).to_numpy(float) - 1 + weight)[:, None]
        host = np.log(np.where(known[:, None], np.maximum(on_host, 1e-12), prior))
        return pd.Series(list(_softmax(held(logs) + held(declared) + held(suffix) + host)), dtype=object)

    return fuse("logs", "alone", "declared_logs", "suffix_logs", "sums", "drawn", "host_items")


def _sums(items: DataFrame, key: str, size: int) -> DataFrame:
    """Per value of a column: its items, and the sum of each language's posterior."""
    return items.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("items"), F.array(*(F.sum(F.col("alone")[k]) for k in range(size))).alias("sums")
    )


def identify(
    items: DataFrame,
    table: np.ndarray,
    *,
    keys: Sequence[str],
    languages: Sequence[str] = LANGUAGES,
    weight: float = WEIGHT,
    confident: float = CONFIDENT,
) -> DataFrame:
    """One row per item: its keys, language, confidence, text_language, kept.

    ``items`` has text, declared, suffix and host, any of them null: null and odd values are no
    evidence. ``language`` is the most probable (ties: the first in ``languages``),
    ``text_language`` the most probable by text alone. An item is kept if it has letters, its
    text is likelier in its language than with all trigrams alike, and the confidence is at
    least ``confident``; else it is rejected. Repeated rows count each. An empty table gives
    no rows; other columns are ignored.
    """
    spark, size = items.sparkSession, len(languages)
    shared = spark.sparkContext.broadcast(table)  # GRAMS rows
    declared = F.regexp_extract(F.lower("declared"), r"^\s*([a-z]{2,3})([-_].*)?\s*$", 1)
    suffix = F.regexp_extract(F.lower("suffix"), r"^([a-z]{2,24})$", 1)
    host = F.lower("host")
    domain = F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)
    some = items.select(
        *keys,
        F.when(declared != "", declared).alias("declared"),
        F.when(suffix != "", suffix).alias("suffix"),
        F.when(host != "", host).alias("host"),
        F.when(host != "", domain).alias("domain"),
        _read(shared).alias("read"),
    )
    some = saved(some.select("*", "read.*").drop("read"), "language-evidence")

    totals = some.agg(*(F.sum(F.col("alone")[k]) for k in range(size))).first()
    totals = [(t or 0.0) + 1.0 for t in totals]
    prior = [t / sum(totals) for t in totals]

    def likelihood(key: str) -> DataFrame:
        seen = _sums(some, key, size)
        every = F.col("items") / sum(totals)
        logs = [F.log((F.col("sums")[k] + weight * every) / (totals[k] + weight)) for k in range(size)]
        return seen.select(key, "items", F.array(*logs).alias(f"{key}_logs"))

    domains = _sums(some, "domain", size)
    drawn = [(F.col("sums")[k] + weight * prior[k]) / (F.col("items") + weight) for k in range(size)]
    domains = domains.select("domain", F.array(*drawn).alias("drawn"))
    hosts = _sums(some.filter("host is not null"), "host", size).withColumn(
        "domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    )
    hosts = hosts.join(domains, "domain").select("host", "items", F.col("items").alias("host_items"), "sums", "drawn")

    rows = some
    for key, values in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", hosts)):
        rows = look_up(rows, saved(values, f"language-{key}"), key, "items").drop("items")
    rows = rows.withColumn("posterior", _fused(prior, weight))
    names = F.array(*(F.lit(x) for x in languages))

    def first(values: str) -> Column:
        return F.array_position(values, F.array_max(values)).cast("int") - 1

    flat = -math.log(GRAMS) / TEMPER
    likely = F.get("logs", first("posterior")) > flat * F.col("grams")
    confidence = F.array_max("posterior")
    return rows.select(
        *keys,
        F.get(names, first("posterior")).alias("language"),
        confidence.alias("confidence"),
        F.get(names, first("alone")).alias("text_language"),
        ((F.col("grams") > 0) & likely & (confidence >= confident)).alias("kept"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, suffix and host of raw pages."""
    shown = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    return pages.select(
        "page_id",
        F.regexp_replace(shown, r"&[a-zA-Z]+;|&#[0-9]+;", " ").alias("text"),
        F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"),
        host.alias("host"),
    )


def document_items(docs: DataFrame) -> DataFrame:
    """doc_id, text, declared, suffix and host of documents, whose source is their host.

    Their ``lang`` is the label that ``fit`` learns from, so it is no evidence here.
    """
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"))
