"""Connected components of a table of links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written

MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) for every node of links (a, b).

    Each round takes the smallest label among a node's neighbours and then that label's own label, so stars end in two
    rounds and chains in about the logarithm of their length. Each round's labels are written to the shared folder.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(MOST_ROUNDS):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("label", "m").alias("label"))
        jump = near.select(F.col("node").alias("via"), F.col("label").alias("next"))
        new = written(near.join(jump, near["label"] == jump["via"]).select("node", F.col("next").alias("label")))
        old = labels.select(F.col("node").alias("n"), F.col("label").alias("was"))
        moved = new.join(old, new["node"] == old["n"]).where(F.col("label") != F.col("was")).isEmpty()
        discard(labels)
        labels = new
        if moved:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
