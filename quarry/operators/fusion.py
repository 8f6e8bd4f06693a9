"""Fusing ranked lists: reciprocal ranks, structural boosts, pins, candidates, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tail_segments, text_tokens
from quarry.functions.vectors import min_max
from quarry.operators.lexical import KEY

RRF_K = 60.0


def _again(rows: DataFrame, k: int | None = None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *KEY)))
    return out if k is None else out.where(F.col("rank") <= k)


def fuse(lexical: DataFrame, semantic: DataFrame, mode: str = "hybrid", sem_weight: float = 0.2, k: int = 256) -> DataFrame:
    """query_id, rank, path, start_line, score. bm25 passes the lexical list through, semantic scores 1 - distance,
    hybrid sums weight / (60 + rank)."""
    if mode == "bm25":
        return _again(lexical.select("query_id", *KEY, "score"), k)
    if mode == "semantic":
        return _again(semantic.select("query_id", *KEY, (1 - F.col("distance")).alias("score")), k)
    parts = lexical.select("query_id", *KEY, (1.0 / (RRF_K + F.col("rank"))).alias("s")).unionByName(semantic.select("query_id", *KEY, (F.lit(sem_weight) / (RRF_K + F.col("rank"))).alias("s")))
    return _again(parts.groupBy("query_id", *KEY).agg(F.sum("s").alias("score")), k)


def share(query_tokens: Column, tokens: Column) -> Column:
    """The part of the distinct query tokens that tokens hold."""
    mine = F.array_distinct(query_tokens)
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, tokens)) / F.size(mine)).otherwise(F.lit(0.0))


def boosted(ranking: DataFrame, queries: DataFrame, declared: DataFrame | None, head: int, decl: float = 0.5, path: float = 0.0) -> DataFrame:
    """The ranking with decl_share and path_share; scores of its head are raised by both, and all is sorted again, ties
    as they were. declared: path, start_line, tokens of the names a chunk declares."""
    rows = ranking.join(queries.select("query_id", text_tokens(F.col("phrase")).alias("_q")), "query_id")
    if declared is not None:
        rows = rows.join(declared.select(*KEY, F.col("tokens").alias("_d")), KEY, "left")
    near = F.col("rank") <= head
    d = F.when(near, share(F.col("_q"), F.coalesce("_d", F.array().cast("array<string>")))).otherwise(0.0) if declared is not None else F.lit(0.0)
    p = F.when(near, share(F.col("_q"), text_tokens(tail_segments(F.col("path"), 2)))).otherwise(0.0)
    rows = rows.withColumn("decl_share", d).withColumn("path_share", p)
    rows = rows.withColumn("score", F.col("score") * (1 + decl * F.col("decl_share")) * (1 + path * F.col("path_share")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank")
    return rows.withColumn("_new", F.row_number().over(w)).drop("rank", "_q", "_d").withColumnRenamed("_new", "rank")


def pinned(ranking: DataFrame, lexical: DataFrame, pins: int = 5) -> DataFrame:
    """The first lexical hits that the ranking misses, under its last row."""
    floor = ranking.groupBy("query_id").agg(F.min("score").alias("floor"), F.max("rank").alias("last"))
    missing = lexical.where(F.col("rank") <= pins).select("query_id", *KEY, F.col("rank").alias("r")).join(ranking.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    missing = missing.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).join(floor, "query_id", "left")
    added = missing.select("query_id", *KEY, (F.coalesce("floor", F.lit(0.0)) - 0.001 * F.col("i")).alias("score"), (F.coalesce("last", F.lit(0)) + F.col("i")).alias("rank"))
    return ranking.unionByName(added, allowMissingColumns=True)


def candidates(ranking: DataFrame, lexical: DataFrame, k: int, pins: int = 5) -> DataFrame:
    """The first 6k rows and the pinned ones, with their lexical rank where it is 16 or better."""
    near = lexical.where(F.col("rank") <= 16).select("query_id", *KEY, F.col("rank").alias("bm25_rank"))
    return ranking.join(near, ["query_id", *KEY], "left").where((F.col("rank") <= 6 * k) | (F.col("bm25_rank") <= pins))


def merge_phrases(rows: DataFrame) -> DataFrame:
    """rows (query_id, p, rank, path, start_line, score) of several phrases as one list: scores on 0..1 in each phrase,
    round-robin by rank, a chunk once, with a mask of the phrases that found it."""
    w = Window.partitionBy("query_id", "p")
    flat = rows.withColumn("score", min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w), 1.0))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "p"))
    flat = flat.withColumn("turn", turn)
    once = flat.groupBy("query_id", *KEY).agg(F.min("turn").alias("turn"), F.min_by("score", "turn").alias("score"), F.bit_or(F.expr("shiftleft(1, p)")).alias("phrases"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))).drop("turn")
