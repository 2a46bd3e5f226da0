"""Connected components by alternating large-star and small-star steps, without a hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, salted_join


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that can be reached.

    Each step is one smallest-neighbour sum by node and one join back to the edges; the edges never grow,
    are written to the shared folder after every step, and end as stars around the smallest nodes. A node with very many
    edges is joined in salted parts.
    """
    edges = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = None
    for _ in range(limit):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both, least, ["u"]).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = scratch.table(large.where("a <> b"))
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = salted_join(large, least, ["b"])
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select("m", "b")).where("x <> y")
        new = scratch.table(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(edges, large)
        edges, before = new, state
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return stars.union(edges.select("a", "a").distinct())
    raise RuntimeError("components did not settle")
