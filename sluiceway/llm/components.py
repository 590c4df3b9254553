"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.tables import saved


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b: long): node, component, its smallest reachable node.

    Each round orders the nodes by a hash that is new in that round, sends every node to the
    first among itself, its neighbours and theirs, and rewrites the links accordingly. A star
    goes in one round and of a chain a fixed share of the nodes is expected to, so the rounds
    grow as the logarithm of the nodes at most. Going back, each node takes the component of
    the node it was sent to. A node's links are combined in the map tasks, whatever their
    number. Links with a null end, loops and repeated links change nothing; no links give no
    rows.
    """
    edges = saved(links.filter("a <> b").select("a", "b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    levels = []
    while not edges.isEmpty():
        order = F.lit(len(levels))
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.unionByName(edges.select(F.explode(F.array("a", "b")).alias("a")).select("a", F.col("a").alias("b")))
        near = ends.groupBy(F.col("a").alias("b")).agg(F.min(F.struct(F.xxhash64("b", order), "b")).alias("first"))
        to = saved(
            ends.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("first")["b"].alias("parent")),
            "parents",
        )
        levels.append(to)
        left = to.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = to.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = saved(
            edges.join(left, "a")
            .join(right, "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "links",
        )
    found = levels.pop().withColumnRenamed("parent", "root")
    while levels:
        above = found.select(F.col("node").alias("parent"), "root")
        found = saved(
            levels.pop().join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")),
            "roots",
        )
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(smallest, "root").select("node", "component")
