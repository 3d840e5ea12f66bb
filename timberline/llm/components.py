"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import in_files, saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``u, v`` edges -> ``node, component`` for every node of an edge; the component is its smallest node.

    Edges may repeat, loops and NULLs are left out; ``rows`` is a bound on their number where one is known. Each round writes its edges to the shared folder. Rounds grow
    with the logarithm of the longest path; every exchange is a partial aggregate or a join that can be split.
    """
    pair = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = saved(pair if rows is None else in_files(pair, rows), "components")
    mark = _signature(now)
    while mark[0]:
        after = saved(in_files(_small_star(_large_star(now)), mark[0]), "components")  # neither star makes more edges
        new = _signature(after)
        done, now, mark = new == mark, after, new
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
