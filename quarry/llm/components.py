"""Connected components by alternating large and small stars, over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, spread_join


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n"))
    return spread_join(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    joined = spread_join(edges, least, "a", total)
    return joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: root is the least node that edges (a, b, in any direction) reach.

    Nodes without an edge, and loops, give no row. Each round writes its edges to the checkpoint folder; it ends
    when a round changes nothing, which each round brings nearer, so there is no cap on rounds. A node with very many
    edges, the least of a large component above all, is joined where its edges lie.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, before = checkpointed(edges), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if not state.n or state == before:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        before = state
        edges = checkpointed(_small(checkpointed(_large(edges, state.n)), state.n))
