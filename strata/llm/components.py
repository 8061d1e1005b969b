"""Connected components of a graph whose edges stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node reachable.

    Rounds of hooking and contraction: every node points at its least smaller neighbour, pointers are followed to
    their ends by doubling steps, and edges are renamed to the ends and those inside a tree dropped.  A node
    that isn't the least of its neighbours goes in each round, so edges shrink from round to round and the work is in
    proportion to the first round's.
    """
    edges = store(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    labels = store(edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while edges.limit(1).count():
        up = store(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), "labels-up")
        while True:  # a pointer at a pointer takes over its end
            further = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("over")), "up", "left")
            new = store(further.select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "labels-up")
            moved = new.filter("moved").limit(1).count()
            remove(up)
            up = new.select("node", "up")
            up.stored_at = new.stored_at
            if not moved:
                break

        def renamed(df: DataFrame, column: str) -> DataFrame:
            return df.join(up.select(F.col("node").alias(column), F.col("up").alias("_end")), column, "left").withColumn(column, F.coalesce("_end", column)).drop("_end")

        next_labels = store(renamed(labels, "root").select("node", "root"), "labels")
        next_edges = renamed(renamed(edges, "lo"), "hi").filter("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
        next_edges = store(next_edges, "links")
        for old in (edges, labels, up):
            remove(old)
        edges, labels = next_edges, next_labels
    remove(edges)
    return labels
