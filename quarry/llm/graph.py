"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import discard, keep


def _are_stars(links: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one alone, which has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    nodes = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return nodes.agg(F.coalesce(F.max(F.col("smaller") + F.col("larger")), F.lit(0)).alias("most")).first()["most"] <= 1


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Smallest node reachable from each node that has an edge to another: node, component.

    ``edges``: a, b (long); direction, repeats and loops don't matter; rows with a null are left out. Each round links a
    node's larger neighbours to its smallest one, then its smaller ones; rounds end as soon as the edges are stars.
    Every round is written to the shared folder, and the one before is freed. Groups are only reduced to their minimum, so that a node with very
    many neighbours is never gathered in one task.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    links = keep(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _are_stars(links):
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node's smaller neighbours, and the node, are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        after = keep(small.where("a <> b").distinct(), name)
        discard(links)
        links = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
