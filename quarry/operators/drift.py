"""What changed since an index was built, and rankings that take the changes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DRIFT = 0.05


def diff(indexed: DataFrame, live: DataFrame, content: bool = False) -> DataFrame:
    """path, change (added, modified, deleted) between two file tables, by size and mtime, or by a digest of the text."""
    mark = (lambda df: F.xxhash64("text")) if content else (lambda df: F.struct("size", "mtime"))
    old = indexed.select("path", mark(indexed).alias("old"))
    new = live.select("path", mark(live).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def drift_ratio(changes: DataFrame, indexed: DataFrame, live: DataFrame) -> DataFrame:
    """One row: dirty files over the larger of both tables."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(changes, "dirty").crossJoin(n(indexed, "n_indexed")).crossJoin(n(live, "n_live"))
    return one.withColumn("ratio", F.when(F.greatest("n_indexed", "n_live") > 0, F.col("dirty") / F.greatest("n_indexed", "n_live")).otherwise(0.0))


def overlay(base: DataFrame, delta: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of an index without those of changed or deleted files, with those of new text."""
    gone = changes.where("change <> 'added'").select("path")
    return base.join(gone, "path", "left_anti").unionByName(delta)


def delta_files(live: DataFrame, changes: DataFrame) -> DataFrame:
    return live.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")


def evicted(entries: DataFrame, most: int) -> DataFrame:
    """The cache entries to drop: dead ones, then the oldest until the rest holds at most `most` bytes. entries: dir,
    bytes, age, dead, protected. The registry has a row for each index, so one ordered window serves."""
    alive = entries.where("NOT dead")
    w = Window.orderBy(F.desc("protected"), "age", "dir").rowsBetween(Window.unboundedPreceding, 0)
    over = alive.withColumn("held", F.sum("bytes").over(w)).where((F.col("held") > most) & ~F.col("protected")).select("dir")
    return entries.where("dead").select("dir", F.lit("dead").alias("why")).unionByName(over.select("dir", F.lit("over budget").alias("why")))


def covering(entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope, dir: for each scope the deepest entry whose root holds it and whose params are the same."""
    holds = (F.col("scope") == F.col("root")) | F.col("scope").startswith(F.concat("root", F.lit("/")))
    pairs = scopes.join(entries, (scopes.params == entries.entry_params) & holds)
    return pairs.groupBy("scope").agg(F.max_by("dir", F.struct(F.length("root"), "dir")).alias("dir"))
