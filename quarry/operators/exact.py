"""Exact search: every line that a pattern matches, with counts that no limit touches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.corpus import lines


def matches(line: Column, pattern: str, literal: bool = False, ignore_case: bool = False, word: bool = False) -> Column:
    """Whether a line holds the pattern; word asks for no word character on either side."""
    if literal and not ignore_case and not word:
        return line.contains(pattern)
    body = re.escape(pattern) if literal else pattern
    body = rf"(?<!\w)(?:{body})(?!\w)" if word else body
    return line.rlike(("(?iuU)" if ignore_case else "(?U)") + body)


def search(files: DataFrame, pattern: str, **how) -> DataFrame:
    """path, line_no, line of each line that matches: one row a line. Files with a zero byte end there."""
    text = files.select("path", F.substring_index("text", "\0", 1).alias("text"))
    whole = text.where(F.col("text").contains(pattern)) if how.get("literal") and not how.get("ignore_case") else text
    return lines(whole).where(matches(F.col("line"), pattern, **how))


def per_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("n"))


def totals(hits: DataFrame) -> DataFrame:
    """One row: all matching lines and files, whatever is printed."""
    return per_file(hits).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("files"))


def head(hits: DataFrame, limit: int = 250) -> DataFrame:
    """The first hits by path and line, as a report prints them."""
    return hits.orderBy("path", "line_no", "line").limit(limit)


def context(files: DataFrame, hits: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """path, line_no, line, is_hit, block: the lines around hits, windows that touch in one block."""
    around = hits.select("path", F.col("line_no").alias("hit"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_no") - before), F.col("line_no") + after)).alias("line_no"))
    wanted = around.groupBy("path", "line_no").agg(F.max(F.col("hit") == F.col("line_no")).alias("is_hit"))
    shown = lines(files.join(hits.select("path").distinct(), "path", "left_semi")).join(wanted, ["path", "line_no"])
    w = Window.partitionBy("path").orderBy("line_no")
    new = (F.col("line_no") - F.lag("line_no", 1, -1).over(w) > 1).cast("long")
    return shown.withColumn("new", new).withColumn("block", F.sum("new").over(w)).select("path", "line_no", "line", "is_hit", "block")
