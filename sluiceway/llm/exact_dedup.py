"""Exact deduplication that no group of copies can overload.

1. Locally: each task keeps one row per digest and content (the map side of the first
   aggregation), however many copies it reads.
2. Salted: those rows meet by digest and salt. All rows of a task have the same salt, so a
   content adds at most one row per task here, spread over the salts.
3. Globally: the at most ``salts`` winners of a content are combined.

Every stage groups by the content itself beside its digest, so texts that merely share a
digest stay apart. What remains is one small row per content. Its digest alone names a
content unless the last stage has found two under it; only rows of such digests take their
content along when each document looks up its group. Contents with at least a thousandth of
all rows number a thousand at most: they are looked up in a broadcast, the rest by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.tables import look_up, saved

SALTS = 16


def sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    *,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical; a null text is an empty one. The largest ``doc_id`` of
    equal texts stays; a null id is smaller than any other and, alone with its text, stays.
    Repeated rows count each and have equal results, so copies of a kept row are all marked
    kept. An empty table gives no rows. Other columns are ignored. ``digest`` need not be
    free of clashes.
    """
    content = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", content.alias("content")).withColumn("digest", digest(F.col("content")))
    one_size = [F.max("best").alias("keep_id"), F.sum("n").alias("group_size")]
    contents = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "content")
        .agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
        .repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    )
    groups = saved(
        contents.groupBy("digest").agg(*one_size, F.count("*").alias("contents")), "exact-groups"
    )
    found = look_up(
        rows.select("doc_id", "digest"),
        groups.filter("contents = 1").drop("contents"),
        "digest",
        "group_size",
    )
    clashing = groups.filter("contents > 1").select("digest")
    if not clashing.isEmpty():
        some = rows.join(clashing, "digest", "left_semi")
        each = some.groupBy("digest", "content").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        )
        found = found.join(clashing, "digest", "left_anti").unionByName(
            some.join(each, ["digest", "content"]).select(found.columns)
        )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )

