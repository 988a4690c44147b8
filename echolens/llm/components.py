"""Connected components by contraction; labels live in tables only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes of edges ``(a, b)``: the smallest node of each component.

    Each round points every node at the smallest node around it, or itself, and then at that one's own choice. Edges are
    carried over to the nodes that theirs point at; those within one node go, and equal ones become one, so the
    edges shrink from round to round and a dense group costs its edges about once. Rounds grow with the logarithm of the
    longest path in practice. No edges give no rows.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(left.select("b", "a"))
        nearest = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), "nearest")
        onward = nearest.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(nearest.join(onward, "label").select("node", F.col("further").alias("label")), "moved")
        if labels is None:
            labels = moved
        else:
            onward = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = written(labels.join(onward, "label", "left")
                             .select("node", F.coalesce("further", "label").alias("label")), "labels")
        to = lambda end: moved.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))
        carried = left.join(to("a"), "a").join(to("b"), "b").where("a_to != b_to")
        left = written(carried.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                       .distinct(), "edges")
        if left.isEmpty():
            return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, label)`` after further links ``(a, b)``, which are carried over to the labels known so far."""
    if labels is None:
        return components(links)
    to = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))
    higher = components(links.join(to("a"), "a", "left").join(to("b"), "b", "left")
                        .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")))
    onward = higher.select(F.col("node").alias("label"), F.col("label").alias("further"))
    known = labels.join(onward, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return written(known.unionAll(higher.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
