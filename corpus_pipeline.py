"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a frame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``, and any
others that ``docs`` has.

Stages decide by row: rows that share a doc_id, or lack one, are told apart (``by_row``), so a text goes
only for what it is itself. Of rows that are alike in all columns one stays, as copies. Null
texts and texts without letters are rejected by the first stage; what reaches the others counts as empty.
Texts are read whole, whatever their length, and an empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm.exact_dedup import exact_groups
from sluiceway.llm.jaccard_join import similar_components
from sluiceway.llm.language import document_items, fit, identify
from sluiceway.llm.packing import pack
from sluiceway.llm.queries import given, tokenizer
from sluiceway.llm.substrings import repeated_passages, without_repeats
from sluiceway.llm.tables import by_row, saved, without


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with their row's number as doc_id, and the id itself as ``__given_id``."""
    return by_row(docs).withColumnRenamed("doc_id", "__given_id").withColumnRenamed("__row", "doc_id")


def _as_given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.drop("doc_id").withColumnRenamed("__given_id", "doc_id").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an ascertained language; those without letters or a likely one go.

    Ties between languages go to the first. Repeated rows stay or go together.
    """
    rows = _by_row(docs)
    found = identify(document_items(rows), fit(docs), keys=("doc_id",))
    rejected = saved(found.filter("not kept").select("doc_id"), "rejected")
    return _as_given(without(rows, rejected, "doc_id"), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id, and one row of it.

    A null doc_id is the smallest. Null texts are equal to empty ones.
    """
    rows = _by_row(docs)
    copies = saved(exact_groups(rows).filter("not kept").select("doc_id"), "copies")
    return _as_given(without(rows, copies, "doc_id"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in their word shingles, directly or in a chain, the smallest doc_id.

    Texts without words are alike to none and stay. Of rows with the same id one stays for each group.
    """
    rows = _by_row(docs)
    copies = similar_components(rows).filter("doc_id <> component_id").select("doc_id")
    return _as_given(without(rows, saved(copies, "near-copies"), "doc_id"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages of 50 words and more that an earlier document has.

    Earlier is the smaller doc_id; rows with the same id are put in order. ``n_chars`` follows.
    """
    rows = _by_row(docs)
    return _as_given(without_repeats(rows, repeated_passages(rows)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence of 1024 tokens.

    Rows with the same id are packed each; an empty text is one piece, its end.
    """
    return pack(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL has no tokenizer and cannot tell the passages; a test compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    frame = given(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        frame = saved(stage(spark, frame, sf_dir), name)
    return STAGES[-1][1](spark, frame, sf_dir)
