"""Keep the latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.columns import is_orderable, quoted

_RANK = "__latest_rank"


def keep_latest(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ("_ingest_ts",)
) -> DataFrame:
    """One row per key: the greatest by ``order_by``, nulls last.

    Ties are broken by the other sortable columns, so the result does not depend on
    how rows arrive. Rows whose key is null form one group.

    The ``rank == 1`` filter sits directly on the window, so Spark keeps one row per
    key in each map task before the shuffle: a key that holds a third of all rows
    sends one row per task, not its whole group.
    """
    if not keys:
        raise ValueError("keep_latest needs at least one key column")
    ranked = [*order_by]
    ranked += [
        f.name
        for f in df.schema.fields
        if f.name not in keys and f.name not in ranked and is_orderable(f.dataType)
    ]
    latest_first = Window.partitionBy(*map(quoted, keys)).orderBy(
        *(quoted(c).desc() for c in ranked)
    )
    return (
        df.withColumn(_RANK, F.row_number().over(latest_first))
        .filter(F.col(_RANK) == 1)
        .drop(_RANK)
    )
