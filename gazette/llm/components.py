"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import stage


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def content(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their 64-bit hashes: what two steps are compared by."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``node``, ``component``.

    Large-star and small-star steps alternate until nothing changes: each node's larger neighbours, and then the node with
    its smaller ones, move to the smallest neighbour. A step is one join on the minima by node, which the planner may
    split where a node is hot; every round is written to the shared folder. Null nodes and loops have no part.
    """
    edges = stage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = content(edges)
    while True:
        around = both_ways(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        small = stage(small.where("a <> b").distinct(), "edges")
        after = content(small)
        if after == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select("b", "b").distinct())
        edges, before = small, after
