"""Connected components of a graph of any size, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and component (one of its nodes) for every node of edges (a, b; longs without nulls, in no order).

    In each round every node goes to the least of itself and its neighbours, and edges to what their ends went to;
    ids are hashes, so a round leaves about a third of the nodes, and rounds grow as the logarithm of the longest path.
    Then the rounds' maps are followed, the last first. Every round is a written table. Edges of a hub are summed
    before they are shuffled, and joined in a way that Spark can split. No edges give no rows.
    """
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "next")
        step = both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("parent"))
        step = materialize(step, "round")
        rounds.append(step)
        from_a = step.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        from_b = step.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(from_a, "a").select("b", "pa").join(from_b, "b").filter("pa <> pb")
        left = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = rounds[-1].select("node", F.col("parent").alias("component"))
    for step in rounds[-2::-1]:
        known = label.withColumnRenamed("node", "parent")
        label = step.join(known, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
        label = materialize(label, "labels")
    return label
