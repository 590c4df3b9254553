"""Find the keys that hold so many rows that one task should not take them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import quoted
from sluiceway.operators.sizes import is_small

# Up to this many rows a key is no burden for a single task, whatever the other keys hold.
HOT_ROWS = 1_000_000
# The column that says into how many parts a key's rows are to be split.
PARTS = "__parts"
_BUCKETS = 1 << 14
_MOST_BUCKETS = 1 << 20


def hot_keys(
    df: DataFrame, keys: Sequence[str], total: int, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """The keys with more than ``hot_rows`` of the ``total`` rows, and ``PARTS`` for each.

    None if there are none. Hash buckets are counted first, which shuffles a few rows per
    task and not the keys; keys are counted exactly only within the buckets heavy enough
    to hide a hot one. There are at most ``total / hot_rows`` such keys, so their number grows
    with the frame: the result says that it may be broadcast only if it is small.
    """
    hot_rows = max(1, hot_rows)
    if total <= hot_rows:
        return None
    columns = [quoted(k) for k in keys]
    buckets = min(_MOST_BUCKETS, max(_BUCKETS, 1 << (4 * total // hot_rows).bit_length()))
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets))
    sizes = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    heavy = sizes.filter(F.col("__n") > hot_rows).select("__bucket")
    if heavy.isEmpty():
        return None
    hot = (
        df.select(*columns)
        .withColumn("__bucket", bucket)
        .join(F.broadcast(heavy), "__bucket", "left_semi")  # at most _MOST_BUCKETS numbers
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > hot_rows)
        .select(*columns, F.ceil(F.col("__n") / hot_rows).alias(PARTS))
    )
    if hot.isEmpty():
        return None
    return F.broadcast(hot) if is_small(hot) else hot
