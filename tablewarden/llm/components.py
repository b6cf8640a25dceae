"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b): only the labels that the links join are worked on. A node not among labels is its own label so far."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = stored(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct())
    if joined.isEmpty():
        dropped(joined)
        return labels
    named = components(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct(), joined)
    new = named.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    out = stored(labels.join(new, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("joined", "label").alias("label")))
    dropped(joined)
    dropped(named)
    return out


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable over links (a, b). Every link's ends must be among nodes.

    Each round takes the least label among neighbours and then follows labels once, so the
    rounds grow with the logarithm of the longest path. Labels are written every round,
    those of the round before are removed.
    """
    ends = links.select("a", "b").where("a <> b")
    edges = stored(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, last = nodes.select("node", F.col("node").alias("label")), None
    while True:
        least = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("other"))
        near = labels.join(least, labels["node"] == least["a"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("other", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        now = stored(near.join(jump, near["label"] == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        if last is not None:
            dropped(last)
        labels, last = now.select("node", "label"), now
        if now.where("label <> was").isEmpty():
            dropped(edges)
            return labels
