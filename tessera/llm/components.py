"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stored

MOST_ROUNDS = 64


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's greater neighbours point to its least one. small: a node and its lesser ones do."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node points to one lesser node at most, and none that is pointed to points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not per_node.where("out > 1 or (out = 1 and into = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node that can be reached. Raises if it doesn't settle."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = stored(_stars(_stars(edges, True), False), "edges")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
