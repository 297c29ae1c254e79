"""Connected components of an edge table by alternating large and small stars.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor
costs one round's task. It ends when the edges are stars: no node has two centres or is one as
well as a leaf. Nothing is collected but whether there is such a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeframe.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "graph", rounds: int = 60) -> DataFrame:
    """(node, root): of each node with an edge (u, v), the smallest node that it reaches.

    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    now = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for i in range(1, rounds + 1):
        if stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{i}-large")
        large = scratch.table(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"{name}-{i}-a")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{i}-small")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{i}")
        for old in (f"{name}-{i - 1}", f"{name}-{i}-large", f"{name}-{i}-a", f"{name}-{i}-small"):
            scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars around their v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(False).alias("centre")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(True).alias("centre")))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 OR leaf = 1 AND centre").isEmpty()
