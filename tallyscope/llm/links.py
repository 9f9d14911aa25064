"""Connected components of links between documents, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``: root is the smallest node it is connected to.

    Alternating large-star and small-star rounds, logarithmic in the diameter.
    The least neighbour of every node is aggregated map-side first and written,
    so the join that hands it out reads two tables and a hub's rows can be split
    over tasks.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def handed(rows: DataFrame) -> DataFrame:
        least = checkpointed(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        return rows.join(least, "u"), least

    def settled(rows: DataFrame) -> bool:
        """Every node hangs on one other, which hangs on none."""
        n, nodes = rows.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        return n == nodes and rows.select(F.col("v").alias("u")).join(rows.select("u"), "u", "left_semi").isEmpty()

    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = handed(both)
        e = checkpointed(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        joined, least = handed(e)
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(moved.where("u <> v").distinct())
        if settled(e):
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
