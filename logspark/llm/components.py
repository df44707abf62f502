"""Connected components by alternating star contractions, every step a DataFrame job.

Each round turns the edges first towards the smallest neighbour of every node (large star),
then links all smaller neighbours of a node to their minimum (small star). Both steps keep
components and need only partially aggregated minima and joins on node ids, so a hub is
never gathered in one task; the rounds needed grow with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = _smallest(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
        F.struct(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("e")).select("e.*")
    odd = ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)")
    return odd.isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Loops, repeated and null edges are ignored. Nodes may be of any ordered type.
    """
    now = checkpointed(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"),
                     (F.col(left).isNotNull() & F.col(right).isNotNull()).alias("whole"))
        .where("whole and u <> v").select("u", "v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while not _is_stars(now):
        now = checkpointed(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
