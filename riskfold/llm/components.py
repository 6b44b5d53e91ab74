"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import join_groups, stage


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): every edge with the least neighbour of ``u``, ``u`` included.
    A node with very many neighbours is spread by :func:`join_groups`."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_groups(edges, stage(least, "least"), "u", "n", total)


def _settled(stars: DataFrame) -> bool:
    """Whether every component is a star around its least node: no node has two lesser
    neighbours, and none that has one is the lesser neighbour of another."""
    ends = (stars.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (a, b); the label
    is the least node of the component.  Each step is aggregates and joins over
    staged edges; the number of steps grows with the logarithm of the nodes."""
    stars = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    while not _settled(stars):
        total = 2 * stars.count()
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: neighbours above u point to the least neighbour of u
        large = _with_least(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        # small-star: u and its lesser neighbours point to the least of them
        near = _with_least(large, total)
        small = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = stage(small, "small-star")
    labels = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) of components after the undirected ``edges`` (a, b) between
    them, or nodes without a label, have come in: only the components that they touch are searched."""
    one, two = (labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
    between = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    moved = stage(connected_components(between), "moved")
    kept = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return kept.select("node", F.coalesce("to", "label").alias("label")).unionByName(moved).distinct()
