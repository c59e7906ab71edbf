"""Connected components of an edge table, by repeated contraction.

Every node points to its smallest neighbour (or itself), pointers are
followed twice, and the edges are rewritten between what the pointers
reach; edges inside one group vanish.  Rounds go on until no edge is
left, about log(diameter) of them.  Each round is written to the shared
folder, so lineage stays short and a lost executor costs one round's
tasks; nothing is gathered on the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize


def grow_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) with further edges (a, b): as connected_components over all edges, but only components and new edges are contracted."""
    ends = [labels.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}")) for c in ("a", "b")]
    moved = edges.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left")
    joined = connected_components(moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")))
    follow = joined.select(F.col("node").alias("component"), F.col("component").alias("reached"))
    kept = labels.join(follow, "component", "left").select("node", F.coalesce("reached", "component").alias("component"))
    fresh = joined.join(labels, "node", "left_anti").select("node", "component")  # components are nodes with a label of their own
    return materialize(kept.unionByName(fresh), "labels")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that each node reaches; nodes without edges have no row."""
    links = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    while not links.isEmpty():
        smallest = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x"))
        parent = materialize(smallest.select("x.*").groupBy("node").agg(F.min("to").alias("to")), "parents")
        step = parent.select(F.col("node").alias("to"), F.col("to").alias("next"))
        once = parent.join(step, "to").select("node", F.col("next").alias("to"))
        parent = materialize(once.join(step, "to").select("node", F.col("next").alias("to")), "pointers")
        ends = [parent.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b")]
        moved = links.join(ends[0], "a").join(ends[1], "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links = materialize(moved.filter("a < b").distinct(), "edges")
        if labels is None:
            labels = parent.withColumnRenamed("to", "component")
        else:
            follow = parent.select(F.col("node").alias("component"), F.col("to").alias("reached"))
            labels = labels.join(follow, "component", "left").select("node", F.coalesce("reached", "component").alias("component"))
            labels = materialize(labels, "labels")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels
