"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, stored

ROUNDS = 64


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b); label is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then jumps along labels, so the number of rounds grows
    with the logarithm of a component's length. Every round's table is written to the shared folder. Nothing is collected
    but one flag a round. Null ends and loops are ignored.
    """
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    both = stored(clean.unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        onward = moved.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        after = moved.join(onward, "to", "left").select("node", F.least(F.col("to"), F.coalesce("onward", "to")).alias("label"), (F.least(F.col("to"), F.coalesce("onward", "to")) < F.col("label")).alias("changed"))
        after = stored(after, "labels")
        changed = after.where("changed").limit(1).count()
        release(labels)
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
