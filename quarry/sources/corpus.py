"""Corpora as DataFrames of files (path, size, mtime, text), and the lines and scopes taken from them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import glob_match, glob_pattern, under

MAX_FILE_BYTES = 4 << 20
#: Folders that hold an index, at the top of a corpus.
INDEX_DIR = r"^\.quarry(\.[^/]*)?/"


def from_documents(docs: DataFrame) -> DataFrame:
    """One file for each document: lang/source/doc_id.txt."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), "text")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a corpus in a few files would leave most of them idle
    while it is cut into tokens. Larger corpora stay as they are read, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def from_pages(pages: DataFrame) -> DataFrame:
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return pages.select(path.alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.col("html").alias("text"))


def from_conversations(turns: DataFrame) -> DataFrame:
    path = F.concat_ws("/", F.lit("conv"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit("_"), F.col("role"), F.lit(".txt")))
    return turns.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), "text")



def from_folder(spark: SparkSession, root: str, max_bytes: int | None = MAX_FILE_BYTES, hidden: bool = False, ignore: list[str] | None = None, ignored: bool = True) -> DataFrame:
    """The text files below root, with paths relative to it; root may be a file, whose path is then its name.

    Files over max_bytes, binary files, hidden paths and index folders are left out, what `ignore` globs match, and,
    with ignored, what .gitignore and .ignore files in the tree name: each rules its own folder, deeper ones win, and
    .ignore wins over .gitignore. Listing and reading are Spark's own; ids are paths, so no order of
    files has to be agreed on.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named, rules = _unlisted(spark, root, hidden) if not is_file(spark, root) else ([], {})
    if named:
        files = files.select("path", "modificationTime", "length", "content").unionByName(_opened(spark, named))
    clean = re.sub(r"^file:/*|^/+", "", root.rstrip("/"))
    full = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^file:/*|^[a-z]+://[^/]*/", "")
    inside = F.when(full == clean, F.substring_index(full, "/", -1)).otherwise(full.substr(F.lit(len(clean) + 2), F.length(full)))
    files = files.select(inside.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    if ignored:
        files = unignored(files, rules)
    if ignore:
        files = files.where(~glob_match(F.col("path"), ignore))
    return readable(files, max_bytes, hidden)


def readable(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES, hidden: bool = False) -> DataFrame:
    """path, size, mtime, text of the files (path, size, mtime, content) that a walk keeps: of a size, outside of index
    folders, not hidden, without a zero byte in the first 8 KiB."""
    if max_bytes is not None:
        files = files.where(F.col("size") <= max_bytes)
    files = files.where(~F.col("path").rlike(INDEX_DIR))
    if not hidden:
        files = files.where(~F.col("path").rlike(r"(^|/)\.[^/]"))
    files = files.where(F.position(F.lit(bytearray(b"\0")), F.substring("content", 1, 8192)) == 0)
    return files.select("path", "size", "mtime", F.decode("content", "UTF-8").alias("text"))


def is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(place) and fs.getFileStatus(place).isFile()


def ignore_rules(text: str) -> list[str]:
    """The globs of an ignore file: comments and blank lines drop; later rules win."""
    lines = (line.rstrip() for line in text.splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def _unlisted(spark: SparkSession, root: str, hidden: bool) -> tuple[list[tuple], dict[str, str]]:
    """(files, rules): what Spark's own listing leaves out, names that begin with an underscore (or, if asked for, a
    dot), as (path, seconds, bytes), and the texts of the tree's ignore files by path."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/")
    files, rules, todo = [], {}, [(base, False)]
    while todo:
        folder, odd = todo.pop()
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
            path, is_dir = status.getPath().toString(), status.isDirectory()
            name = path.rpartition("/")[2]
            if name in (".gitignore", ".ignore") and not is_dir:
                stream = fs.open(status.getPath())
                rules[path[len(base) + 1 :]] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
            if name.startswith(".") and not hidden or status.isSymlink():
                continue
            unseen = odd or name.startswith((".", "_"))
            if is_dir:
                todo.append((path, unseen))
            elif unseen:
                files.append((path, status.getModificationTime() // 1000, status.getLen()))
    return files, rules


def _opened(spark: SparkSession, named: list[tuple]) -> DataFrame:
    """The files of such names, read where the rows are."""

    def read(stream):
        from pyarrow import fs

        for batch in stream:
            for row in batch.to_pylist():
                source, path = fs.FileSystem.from_uri(row["path"].replace("file:/", "file:///", 1) if row["path"].startswith("file:/") and not row["path"].startswith("file://") else row["path"])
                with source.open_input_stream(path) as f:
                    data = f.read()
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "mtime": [row["mtime"]], "length": [row["length"]], "content": [data]}, schema=pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))

    rows = spark.createDataFrame(named, "path string, mtime long, length long")
    return rows.mapInArrow(read, "path string, mtime long, length long, content binary").select("path", F.timestamp_seconds("mtime").alias("modificationTime"), "length", "content")


#: Rules of ignore files that a walk turns into a predicate.
MANY_RULES = 5000


def unignored(files: DataFrame, texts: dict[str, str]) -> DataFrame:
    """files without what ignore files name: texts has their texts by path. One predicate; a tree with more than
    MANY_RULES rules is an error, not a silent cut."""
    gone, n = F.lit(False), 0
    # outer folders first, and in each .gitignore before .ignore: what comes later decides
    for path in sorted(texts, key=lambda p: (p.count("/"), p.rpartition("/")[0], p.rpartition("/")[2] == ".ignore")):
        folder = path.rpartition("/")[0]
        inside = F.col("path").startswith(folder + "/") if folder else F.lit(True)
        below = F.col("path").substr(F.lit(len(folder) + 2), F.length("path")) if folder else F.col("path")
        for rule in ignore_rules(texts[path]):
            keep, pattern = glob_pattern(rule)
            gone, n = F.when(inside & below.rlike(pattern), F.lit(keep)).otherwise(gone), n + 1
    if n > MANY_RULES:
        raise ValueError(f"more than {MANY_RULES} rules in ignore files")
    return files.where(~gone) if n else files


def scoped(files: DataFrame, prefix: str = "", paths: list[str] | None = None, globs: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """The files in a subtree, under any of several paths, that globs pass, and of a size. A plain predicate on path,
    which belongs below every ranking: a filter above a limit would leave narrow scopes short."""
    out = files.where(under(F.col("path"), prefix)) if prefix else files
    if paths:
        keep = under(F.col("path"), paths[0])
        for p in paths[1:]:
            keep = keep | under(F.col("path"), p)
        out = out.where(keep)
    if globs:
        out = out.where(glob_match(F.col("path"), globs))
    return out if max_bytes is None else out.where(F.col("size") <= max_bytes)


def common_ancestor(paths: list[str]) -> str:
    """The deepest folder that holds all paths."""
    split = [p.strip("/").split("/") for p in paths]
    out = []
    for parts in zip(*split, strict=False):
        if len(set(parts)) > 1:
            break
        out.append(parts[0])
    return "/".join(out)


def line_array(text: Column) -> Column:
    """The lines of a text: split on line feeds, one carriage return dropped at each end, no last empty line."""
    body = F.when(text.endswith("\n"), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text)
    parts = F.split(F.when(text.contains("\r"), F.regexp_replace(body, r"\r(?=\n|\z)", "")).otherwise(body), "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select("path", F.posexplode(line_array(F.col("text"))).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def read_lines(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (path, start_line, end_line) with column body: the lines there are; null if the file is gone."""
    have = files.select("path", line_array(F.col("text")).alias("_lines"))
    body = F.concat_ws("\n", F.slice("_lines", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)))
    return spans.join(have, "path", "left").withColumn("body", F.when(F.col("_lines").isNotNull(), body)).drop("_lines")
