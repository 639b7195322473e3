"""Connected components as DataFrame steps: smallest neighbour, pointer jumping, contraction.

Every round writes its tables to the shared folder, so a lost executor costs one round. A round at
least halves the nodes that still have links; a star of any size ends after one. Nodes with many
neighbours, or below one root, are joined by broadcast (see ``split_join``), so none gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import split_join, written


def _mapped(edges: DataFrame, parent: DataFrame, total: int) -> DataFrame:
    for side in ("a", "b"):
        up = parent.select(F.col("node").alias(side), F.col("up").alias(f"up_{side}"), "degree")
        edges = split_join(edges, up, [side], "degree", total).drop("degree")
    return edges.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).where("a < b").distinct()


def _above(rows: DataFrame, parent: DataFrame, total: int) -> DataFrame:
    """``rows`` (node, up) with ``top``, what ``parent`` has above their ``up``; null where it has nothing."""
    children = rows.groupBy("up").agg(F.count("*").alias("n"))
    above = parent.select(F.col("node").alias("up"), F.col("up").alias("top")).join(children, "up")
    return split_join(rows, above, ["up"], "n", total, "left").drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each end of ``edges`` (a, b): comp is the smallest node reachable. Loops and repeats may occur; no edges give no rows."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    found, nodes = None, 0
    while total := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"), F.count("*").alias("degree"))
        parent = written(parent, "parents")
        while True:  # to the root
            jumped = _above(parent, parent.select("node", "up"), 2 * total)
            jumped = written(jumped.select("node", F.col("top").alias("up"), "degree", (F.col("top") != F.col("up")).alias("moved")), "jumped")
            parent = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parent.select("node", "up")
            nodes = found.count()
        else:
            found = written(_above(found, parent, nodes).select("node", F.coalesce("top", "up").alias("up")), "found")
        edges = written(_mapped(edges, parent, total), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return found.select("node", F.col("up").alias("comp"))
