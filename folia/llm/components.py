"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long); label is the component's least node.

    Alternating hooks and jumps: each root hooks onto the least root next to it, then paths are
    halved by a self-join on labels, which takes a number of rounds logarithmic in the longest
    path. Labels are a written table after each round, so lost executors cost one round at most.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), tag)
    step = labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), tag)
    while True:
        by_a = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        across = by_a.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        # The least label next to any node of a label's tree; the tree hooks onto it.
        hook = across.where("lb < la").groupBy(F.col("la").alias("root")).agg(F.min("lb").alias("to"))
        hooked = labels.join(hook, labels["label"] == hook["root"], "left").select("node", F.col("label").alias("old"), F.coalesce("to", "label").alias("label"))
        # Jump: a node takes the label that its label's node has now.
        now = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        before, step = step, materialize(hooked.join(now, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), tag)
        discard(before)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            discard(both)
            return labels
