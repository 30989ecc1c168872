"""Connected components of a link table, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def _shape(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links ``(a, b)``; nodes without links are absent.

    Alternating star contraction: each node's neighbours are hung below its smallest
    neighbour until nothing changes. Every step is a grouped minimum and a join, and is
    written to the shared folder. Self links, repeated links and an empty table are allowed.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while (now := _shape(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()).distinct()
