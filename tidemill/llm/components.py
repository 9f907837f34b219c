"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the smallest node that is reachable.

    Each round hangs every node on its smallest neighbour, follows the
    pointers to the roots, and goes on with the edges between roots; the
    rounds are few as the graph shrinks to its roots.  All tables are written
    in the shared folder, so lineage stays short.
    """
    edges = edges.select("a", "b").filter("a <> b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "parents")
    while True:  # pointer jumping
        up = parent.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = write_table(parent.join(up, F.col("label") == F.col("_n")).select("node", "_l", (F.col("_l") != F.col("label")).alias("moved")), "jumps")
        parent = jumped.select("node", F.col("_l").alias("label"))
        if jumped.filter("moved").isEmpty():
            break
    left, right = parent.select(F.col("node").alias("a"), F.col("label").alias("la")), parent.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    across = write_table(edges.join(left, "a").join(right, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "across")
    if across.isEmpty():
        return parent
    roots = components(across).select(F.col("node").alias("label"), F.col("label").alias("_root"))
    return parent.join(roots, "label", "left").select("node", F.coalesce("_root", "label").alias("label"))
