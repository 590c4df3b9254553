"""Mixing sources to target weights by systematic sampling.

1. The words of each source are added up. Targets share all words by weight; a target stops at
   ``limit`` times its source's words, and what it leaves is shared again by weight among the
   others, until none is above. A round is one aggregation over the sources.
2. A document's expected copies are its source's target over its source's words. Documents are
   put in order of size within their source; a prefix sum of the expected copies then is the
   document's number times them, and numbers come from one shuffle by range (``numbered``), so a
   source with most of the rows lies in many partitions.
3. One random offset is added to the sums of a source, and a document is taken once for each whole
   number that its step crosses. All of it is whole-number arithmetic, so no step depends on
   rounding or on how rows are partitioned.

As sizes rise with the sums, a source's words come to its target to within the size of its
largest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.tables import numbered, saved

WEIGHTS = (5, 2, 1)
LIMIT = 3
_SPACES = " \t\n\x0b\x0c\r"
_STEPS_LOG = 20  # an offset is one of 2 ** 20 places
_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """The number of words: longest runs of characters other than space and ``\\x09``-``\\x0d``."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, _SPACES, "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Each row of ``sizes`` (source, source_size, once each) with ``weight``, and its target as a ratio.

    Sources in order of their code points, null last, get the weights in turn, again and again.
    The target is ``target_over / target_under`` in whole numbers, both 0 and 1 where there are no words.
    """
    placed = numbered(sizes, [F.col("source").asc_nulls_last()]).withColumn("n", F.col("number") % len(weights))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("n").cast("int") + 1).cast("long")
    placed = saved(placed.withColumn("weight", weight).drop("n", "number"), "sources")
    below, capped, over, under = F.lit(False), None, 0, 1
    while True:
        total = placed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(below, F.col("source_size"))).alias("below"),
            F.sum(F.when(~below, F.col("weight"))).alias("left"),
            F.count_if(below).alias("capped"),
        ).first()
        if not total["all"] or not total["left"] or total["capped"] == capped:
            break
        capped, over, under = total["capped"], total["all"] - limit * (total["below"] or 0), total["left"]
        # Those whose share is above their limit. As the rest shares more, it only grows.
        below = _big("weight") * _big(over) > _big("source_size") * _big(limit * under)
    return placed.select(
        "source",
        "source_size",
        "weight",
        F.when(below, _big("source_size") * limit).otherwise(_big("weight") * _big(over)).cast(_BIG).alias("target_over"),
        F.when(below, F.lit(1)).otherwise(F.lit(under)).cast("long").alias("target_under"),
    )


def _big(value: str | int) -> Column:
    return (F.col(value) if isinstance(value, str) else F.lit(str(value))).cast("decimal(19,0)")


def drawn(
    docs: DataFrame,
    keep: Sequence[str] | None = None,
    *,
    weights: Sequence[int] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = 0,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``copies``.

    ``docs`` has doc_id, text and source; ``keep`` names the columns that are carried along (all of
    them if none are named), and those that have the name of a result are replaced. A null or
    empty text has size 0; null sources are one source, the last. Very long texts count in
    full. Documents of one size are in an order that ``seed`` and their doc_id decide, then by doc_id,
    nulls first; repeated rows count each, stand next to one another, and share the copies that
    fall to them. A source without words has target 0 and no copies; an empty table gives no
    rows. No document is copied more than ``limit`` times, and the result does not depend on
    how rows arrive.
    """
    own = ["size", "source_size", "target", "copies"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    rows = docs.select(
        F.struct(*keep).alias("kept"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}/"), F.col("doc_id").cast("string"))).alias("shuffled"),
        F.col("doc_id").alias("id"),
    )
    # Written first: putting rows in order reads them twice, and words are to be counted once.
    rows = saved(rows, "sized")
    order = [F.col("source").asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in ("size", "shuffled", "id"))]
    placed = numbered(rows, order, ["source"]).drop("shuffled", "id")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, limit)
    # The place of the offset, of 2 ** 20, is drawn for each source.
    name = F.concat(F.lit(f"{seed}/source/"), F.coalesce("source", F.lit("")))
    offset = F.conv(F.substring(F.md5(name), 1, _STEPS_LOG // 4), 16, 10).cast("long")
    targets = targets.withColumn("offset", offset).withColumnRenamed("source", "__source")

    def crossed(number: Column) -> Column:
        """Whole numbers up to the sum of ``number`` documents' expected copies and the offset."""
        steps = F.lit(1 << _STEPS_LOG).cast("decimal(7,0)")
        under = F.col("target_under") * F.col("source_size").cast("decimal(19,0)")
        over = number.cast("decimal(13,0)") * F.col("target_over").cast("decimal(18,0)") * steps
        return F.call_function(
            "div", over.cast(_BIG) + (F.col("offset") * under).cast(_BIG), (under * steps).cast(_BIG)
        )

    # There are as many rows here as sources; AQE splits what a hot one has where it does not broadcast.
    found = placed.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.when(F.col("source_size") > 0, crossed(F.col("number") + 1) - crossed(F.col("number"))).otherwise(0)
    return found.select(
        *(F.col(f"kept.`{c}`").alias(c) for c in keep),
        "size",
        "source_size",
        (F.col("target_over").cast("double") / F.col("target_under").cast("double")).alias("target"),
        copies.cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: rows of ``docs``, each as often as ``drawn`` takes it, with ``copy`` counting from 1."""
    rows = drawn(docs, **options)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.filter("copies > 0").select(*(c for c in docs.columns if c != "copy"), copy.alias("copy"))
