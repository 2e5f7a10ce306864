"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countspark.session import keep, keep_measured


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the smallest node of the component.

    Alternates large-star and small-star steps until the links are a set of stars. Each step is two aggregates-and-joins; the smallest
    neighbour is a partial aggregate and the join back can be split by adaptive execution, so a node may hold any share of the links.
    Every step is written to the shared folder, which cuts the lineage.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: every larger neighbour goes to the smallest node of the neighbourhood (the node itself included)
        near = both(edges)
        least = near.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        edges = keep(near.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: all smaller neighbours, and the node, go to the smallest of them
        least = edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        moved = edges.join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stay = least.select(F.col("of").alias("a"), F.col("m").alias("b"))
        edges, seen = keep_measured(moved.unionByName(stay).where("a <> b").distinct(), total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if seen == before:
            break
        before = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
