"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from driftcurve.llm.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every node of `edges` (src, dst: long) with the smallest node it reaches.

    Returns (node, label) for the nodes that occur in an edge. Each round takes the least label among
    a node's neighbours and then follows the label once more (pointer jumping), so the number of rounds
    grows with the logarithm of the longest path. Each round's labels are written to the shared folder
    and reread, so every join reads plain tables: its inputs are shuffled by key and a hub node's
    partition can be split by adaptive execution. Null ends are ignored; an empty table gives an empty one.
    """
    ends = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    both = ends.select("src", "dst").union(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).union(
        ends.select("src", F.col("src").alias("dst"))
    ).union(ends.select(F.col("dst").alias("src"), "dst")).distinct()
    both = scratch.table(both, "cc-edges")
    labels = scratch.table(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")), "cc-labels-0")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    for k in count(1):  # ends: labels only fall, and each round that changes none is the last
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("label"))
        near = scratch.table(near, f"cc-near-{k}")
        far = near.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        jumped = near.join(far, near.label == far.via).select("node", F.col("beyond").alias("label"))
        jumped = scratch.table(jumped, f"cc-labels-{k}")
        scratch.drop(f"cc-labels-{k - 1}")
        scratch.drop(f"cc-near-{k}")
        now = jumped.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        labels = jumped
        if now == total:
            return labels
        total = now
