"""Connected components of an edge table, as joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.shared import hot_join, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u long, v long), with the least node of a component as its root.

    Alternates large and small stars, each a minimum by node and a join, so the rounds grow with the logarithm of a
    component's size and no component is ever gathered in one place. Each round is written to the shared folder.
    Loops and repeated edges do no harm.
    """
    e = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counted = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both.where("v > u"), counted, ["u"], "n", total=2 * e.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node's least neighbour; what a node has besides goes to that one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(linked.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = now
