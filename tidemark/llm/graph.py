"""Connected components of a large edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.

    Each round hooks every node that has a smaller neighbour to its least one, follows the hooks to their roots, and contracts the
    edges; only edges between unlike labels stay, so tables shrink. Nulls and loops are ignored; an edge may repeat.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    e = X.kept(e)
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.col("node"))
    labels = X.kept(labels)
    while not e.isEmpty():
        hook = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        moved = True
        while moved:  # pointer jumping: hooks lead to ever smaller nodes, so chains end at a root
            other = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = X.kept(hook.select("node", "to").join(other, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            moved = not hook.filter("moved").isEmpty()
        to = hook.select(F.col("node").alias("x"), "to")
        labels = X.kept(labels.join(to, labels["label"] == to["x"], "left").select("node", F.coalesce("to", "label").alias("label")))
        for end in ("a", "b"):
            e = e.join(to, e[end] == to["x"], "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        e = X.kept(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    return labels
