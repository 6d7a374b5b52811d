"""Connected components by label propagation with hooking of roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the smallest node reachable.

    A node's label names another node; each round looks at the labels' own
    labels. A node takes the smallest of those beside it, and so does the node
    that its label names, so whole basins of a long chain join at once. Labels
    only fall, and rounds go on until none does. Every round is written to the
    shared folder, and the round before the last is removed; only whether there
    were changes reaches the driver.
    """
    spark, old, new = edges.sparkSession, [], []
    e = edges.select("a", "b").filter("a <> b")
    both = materialise(e.union(e.select("b", "a")).distinct(), "edges")
    lab = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", old)
    while True:
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("up"))
        lab = lab.join(up, "label").select("node", F.col("label").alias("was"), "up")
        seen = both.join(lab.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("m"))
        near = materialise(lab.join(seen, "node").select("node", "was", F.least("up", "m").alias("m")), "near", new)
        root = near.groupBy(F.col("was").alias("node")).agg(F.min("m").alias("r"))
        lab = materialise(near.join(root, "node", "left").select("node", "was", F.least("m", F.coalesce("r", "m")).alias("label")), "labels", new)
        discard(spark, old)
        old, new = new, []
        if lab.filter("label <> was").isEmpty():
            return lab.select("node", "label")
        lab = lab.select("node", "label")


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) of a graph after more links (a, b): components of the few old components that these join."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    e = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(e.distinct())
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return old.unionByName(joined.join(labels.select("node"), "node", "left_anti"))
