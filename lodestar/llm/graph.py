"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.llm.frames import Scratch


def components(scratch: Scratch, links: DataFrame, observed: bool = False) -> DataFrame:
    """``(node, label)`` for every end of a link ``(a, b)``; the label is the component's smallest node.

    Each round a node takes the smallest of its neighbours' labels and its label's label, so labels
    spread over doubling distances and rounds grow slowly with the longest path. Both are joins and minima, partly
    taken before the shuffle; each round's labels are written, so lineage stays one round long. With ``observed`` the
    changes of a round are counted while it is written, and stored ``links`` are read again and not copied: fewer jobs.
    """
    hold = (lambda df: df) if observed else scratch.table
    both = hold(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*"))
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        after = labels.join(seen, "node").join(jump, labels["label"] == jump["via"]).select(
            "node", F.least("label", "near", "next").alias("label"), F.col("label").alias("old")
        )
        if observed:
            seen_changes = Observation()
            after = scratch.table(after.observe(seen_changes, F.count_if(F.col("label") != F.col("old")).alias("n")))
            changed = seen_changes.get["n"] > 0
        else:
            after = scratch.table(after)
            changed = not after.where("label <> old").isEmpty()
        scratch.drop(labels)
        labels = after
        if not changed:
            scratch.drop(both)
            return labels.select("node", "label")
