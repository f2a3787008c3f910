"""Connected components by alternating large-star and small-star steps; every step is a partially aggregated min and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def loose(df: DataFrame, *keys: str) -> DataFrame:
    """df with its key columns recomputed, so that a join on them gets an exchange that adaptive execution can split."""
    return df.select(*[(F.col(c) + F.lit(0)).alias(c) if c in keys else F.col(c) for c in df.columns])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v"), F.col("u")))
    least = loose(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "x")
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(loose(least, "u"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges(u, v) but the roots; component is the smallest node reachable.

    Edges with a null end and loops are ignored; an empty edge table gives no rows. Each round ends in a checkpoint.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut(edges), None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = cut(_small_star(_large_star(edges)))
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
