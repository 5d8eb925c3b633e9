"""Connected components by alternating large-star and small-star steps.

Every step replaces edges by edges towards smaller nodes and keeps the
components; in a few rounds each component is a star around its smallest node
(Kiveris et al., 2014). Edges stay in DataFrames; each round is written to the
shared folder, so lineage does not grow and nothing goes to the driver but two
numbers. A node of many edges finds its least neighbour by a broadcast of such
nodes, so its edges stay spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import spread, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread(both.where("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = spread(edges, least, "u", "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component."""
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _sum(now)
    while before[0]:
        now = stored(_small_star(_large_star(now, before[0]), before[0]), "edges")
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
