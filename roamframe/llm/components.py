"""Connected components by contracting the graph in rounds; no node's links meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.storage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node that links reach.

    Each round points every node at its smallest neighbour, if that is smaller, follows these pointers to
    their ends in doubling steps, and replaces both ends of every link by where they lead. A link between
    two nodes in one place goes. The rounds end when none is left.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        moved = _followed(edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")))
        labels = cut(
            labels.join(moved, F.col("component") == F.col("from"), "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        )
        for end in ("a", "b"):
            edges = edges.join(moved, F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def _followed(moved: DataFrame) -> DataFrame:
    """Pointers (from, to) with every ``to`` replaced by the end of its way: each step doubles what is covered."""
    moved = cut(moved)
    while True:
        onward = moved.select(F.col("from").alias("at"), F.col("to").alias("then"))
        further = cut(moved.join(onward, F.col("to") == F.col("at"), "left").select("from", F.coalesce("then", "to").alias("to"), "then"))
        moved = further.select("from", "to")
        if further.filter("then is not null").isEmpty():
            return moved
