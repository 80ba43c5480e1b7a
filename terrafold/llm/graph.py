"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, longs): the least node it can reach.

    Every round sends each node to the neighbour (or itself) of the least hash and
    contracts the edges, which leaves a fixed share of the nodes of a component in
    expectation, so rounds grow with the logarithm of its size. Minima are summed on
    the map side; a node with very many neighbours can be split in the joins.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = cut(edges.filter("a <> b").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut(nodes.withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        target = both.groupBy("a").agg(F.least(F.min(key("b")), key("a"))["v"].alias("to")).select(F.col("a").alias("from"), "to")
        target = cut(target)
        step = labels.join(target, F.col("label") == F.col("from"), "left")
        labels = cut(step.select("node", F.coalesce("to", "label").alias("label")))
        to_a, to_b = (target.select(F.col("from").alias(f"__{c}"), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, F.col("a") == F.col("__a")).join(to_b, F.col("b") == F.col("__b"))
        edges = cut(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
