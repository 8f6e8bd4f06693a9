"""Reports over runs, traces and query sets: tiers, problems, replays, comparisons, roll-ups. All relational."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name parts that name nothing, path parts that locate nothing, tiers, and where traces come from.
TRIVIAL = ["get", "set", "run", "new", "init", "main", "self", "cls", "test"]
PLACES = ["src", "lib", "test", "tests"]
TIERS, SOURCES = ["blind", "guess", "golden"], ["harvested", "generated", "cosqa"]
#: Rows from which on common terms lose their emphasis, and the share of rows that makes one common.
ROWS_TO_JUDGE, COMMON_SHARE = 6, 0.35

QUERY_ROW = "query_id long, query string, kind string, file string, start_line int, end_line int, symbol string"
TRACE_ROW = "id string, query string, tier string, provenance struct<source: string>, target struct<repo: string, sha: string>, gold struct<funcs: array<string>, files: array<string>>"


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema (QUERY_ROW, TRACE_ROW or one's own); a broken line is an error, not a null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def leaf_names(funcs: Column) -> Column:
    """The class and function names in qualified names `file:Class.method`, short and trivial ones left out."""
    parts = F.flatten(F.transform(F.coalesce(funcs, F.array()), lambda g: F.split(F.regexp_replace(g, "^[^:]*:", ""), r"\.")))
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda p: (F.length(p) > 2) & ~F.lower(p).isin(TRIVIAL)))


def place_names(files: Column) -> Column:
    """The folders and stems of paths in lower case, short and general ones left out."""
    parts = F.flatten(F.transform(F.coalesce(files, F.array()), lambda f: F.split(F.lower(f), "/")))
    stems = F.transform(parts, lambda s: F.regexp_replace(s, r"(?<=.)\.[^.]*$", ""))
    return F.array_distinct(F.filter(stems, lambda s: (F.length(s) > 2) & ~s.isin(PLACES)))


def mentions(text: Column, words: Column) -> Column:
    """Whether text holds one of words, with no letter, digit or underscore on either side."""
    return F.exists(words, lambda w: F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), w, F.lit(r"\E(?![A-Za-z0-9_])"))))


def tier(query: Column, funcs: Column, files: Column) -> Column:
    """golden if a query names a function of the gold, guess if it names its place, else blind; null without a gold."""
    text = F.coalesce(query, F.lit(""))
    some = (F.size(F.coalesce(funcs, F.array())) > 0) | (F.size(F.coalesce(files, F.array())) > 0)
    found = F.when(mentions(text, leaf_names(funcs)), "golden").when(mentions(F.lower(text), place_names(files)), "guess").otherwise("blind")
    return F.when(some, found)


def trace_problems(rows: DataFrame) -> DataFrame:
    """id, problem: what is wrong with trace rows (TRACE_ROW): fields that are missing, a tier that is none or not what
    recomputing gives, an unknown source, an empty query, no gold, an id that several rows have."""
    missing = lambda c: F.when(F.col(c).isNull(), F.lit(f"missing {c}"))
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), ["query", "tier", "provenance", "target", "gold"], F.col("id").isNotNull())
    want = tier(F.col("query"), F.col("gold.funcs"), F.col("gold.files"))
    told = lambda when, name: F.when(whole & F.coalesce(when, F.lit(False)), F.lit(name))
    counted = rows.withColumn("_times", F.count("*").over(Window.partitionBy("id")))
    found = F.array_compact(F.array(
        *[missing(c) for c in ("id", "query", "tier", "provenance", "target", "gold")],
        told(~F.col("tier").isin(TIERS), "unknown tier"), told(~F.coalesce(F.col("provenance.source"), F.lit("")).isin(SOURCES), "unknown source"),
        told(F.trim("query") == "", "empty query"), told(want.isNull(), "no gold"), told(F.col("tier").isin(TIERS) & (want != F.col("tier")), "other tier"),
        F.when(F.col("id").isNotNull() & (F.col("_times") > 1), F.lit("repeated id")),
    ))
    return counted.select("id", F.explode(found).alias("problem"))


def replay(ranks: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """tier, n, recall_1, recall_5, mrr_10 of ranks (id, tier, rank, skipped): tiers are never pooled, rank 0 is a miss,
    rows with a reason in skipped count as n_skipped only. base (id, rank) adds the paired difference of recall at 5, and
    how many rows got better and worse."""
    hit = lambda c, k: F.when(F.col(c).between(1, k), 1.0).otherwise(0.0)
    scored = F.col("skipped").isNull()
    share = lambda x: F.avg(F.when(scored, x))
    out = [F.count_if(scored).alias("n"), F.count_if(~scored).alias("n_skipped"), share(hit("rank", 1)).alias("recall_1"), share(hit("rank", 5)).alias("recall_5"), share(F.when(F.col("rank").between(1, 10), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr_10")]
    if base is None:
        return ranks.groupBy("tier").agg(*out)
    joined = ranks.join(base.select("id", F.col("rank").alias("_base")), "id", "left")
    d = F.when(scored & F.col("_base").isNotNull(), hit("rank", 5) - hit("_base", 5))
    return joined.groupBy("tier").agg(*out, F.avg(d).alias("delta_5"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"))


def ab_table(base: DataFrame, other: DataFrame, metric: str) -> DataFrame:
    """corpus, mode, kind, base, cand, delta of the cells that two runs share and both have the metric of."""
    key = ["corpus", "mode", "kind"]
    both = base.select(*key, F.col(metric).alias("base")).join(other.select(*key, F.col(metric).alias("cand")), key)
    return both.where("base IS NOT NULL AND cand IS NOT NULL").withColumn("delta", F.col("cand") - F.col("base"))


def ab_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"), F.count_if(F.col("delta") == 0).alias("flat"))


def blind_cut(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """mode, kind, stratum, n, recall_5: stored ranks cut into blind and named queries. cells: mode, kind, ordinal, rank
    (0 a miss); queries: kind, ordinal, is_blind, null where the gold can't be read, which leaves the row out."""
    joined = cells.join(queries.where("is_blind IS NOT NULL"), ["kind", "ordinal"])
    stratum = F.when(F.col("is_blind"), "blind").otherwise("named")
    return joined.groupBy("mode", "kind", stratum.alias("stratum")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank").between(1, 5), 1.0).otherwise(0.0)).alias("recall_5"))


def misfits(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """mode, kind of the cells whose ranks are not as many as the query set has rows of the kind: a filtered run."""
    have = queries.groupBy("kind").agg(F.count("*").alias("wanted"))
    return cells.groupBy("mode", "kind").agg(F.count("*").alias("ranks")).join(have, "kind", "left").where("wanted IS NULL OR wanted <> ranks").select("mode", "kind")


def roll_up(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """One row a run: n_cells, n_ranks, query_set, recorded. cells: run, mode, kind, n_ranks, recall_5, queries_fp,
    corpus; sets: queries_fp, name. A run's query set follows from its fingerprint; one that matches none is named so."""
    known = cells.groupBy("run").agg(F.count_if(F.col("recall_5").isNotNull()).alias("n_cells"), F.coalesce(F.sum("n_ranks"), F.lit(0)).alias("n_ranks"), F.max("queries_fp").alias("queries_fp"), F.max("corpus").alias("corpus"))
    named = known.join(sets, "queries_fp", "left")
    unknown = F.when(F.col("queries_fp").isNotNull(), F.concat(F.lit("unknown (fp "), "queries_fp", F.lit(")")))
    return named.select("run", "n_cells", "n_ranks", F.coalesce("name", unknown).alias("query_set"), F.col("corpus").isNotNull().alias("recorded"))


def stage_sums(recorded: DataFrame, schedule: list[tuple[str, str]]) -> DataFrame:
    """place, stage, bucket, ms of every stage of a schedule, zero where nothing was recorded; other stages drop."""
    spark = recorded.sparkSession
    plan = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(schedule)], "place int, stage string, bucket string")
    return plan.join(recorded.groupBy("stage").agg(F.sum("ms").alias("ms")), "stage", "left").select("place", "stage", "bucket", F.coalesce("ms", F.lit(0.0)).alias("ms"))


def emphasis(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term: the terms of a query to set off in its printed rows (query_id, row, tokens): those that not more
    than COMMON_SHARE of the rows hold, once there are ROWS_TO_JUDGE."""
    n = rows.groupBy("query_id").agg(F.count_distinct("row").alias("n"))
    held = rows.select("query_id", "row", F.explode(F.array_distinct("tokens")).alias("term")).join(terms, ["query_id", "term"])
    seen = held.groupBy("query_id", "term").agg(F.count_distinct("row").alias("seen"))
    told = terms.join(seen, ["query_id", "term"], "left").join(n, "query_id")
    return told.where((F.col("n") < ROWS_TO_JUDGE) | (F.coalesce("seen", F.lit(0)) <= F.ceil(F.col("n") * COMMON_SHARE))).select("query_id", "term")


def resumed(wanted: DataFrame, done: DataFrame, header: dict, found: dict | None) -> DataFrame:
    """The (i, mode) of wanted that a checkpoint, done (i, mode, rank), lacks. A checkpoint of another run is refused."""
    if found is not None and found != header:
        raise ValueError(f"the checkpoint is of another run: {found}, not {header}")
    return wanted.join(done, ["i", "mode"], "left_anti")


def selected(rows: DataFrame, where: str) -> DataFrame:
    """The rows that match every clause of `k=v,k=v`, values compared as strings; an unknown field is an error."""
    for clause in filter(None, where.split(",")):
        name, sign, value = (p.strip() for p in clause.partition("="))
        if not sign:
            raise ValueError(f"not k=v: {clause!r}")
        if name not in rows.columns:
            raise ValueError(f"no field {name!r}; there are {sorted(rows.columns)}")
        rows = rows.where(F.coalesce(F.lower(F.col(name).cast("string")), F.lit("none")) == value.lower())
    return rows


def cell(rows: DataFrame, strata: list[str]) -> Column:
    """The kind of a row with the fields that split it further; an unknown field is an error."""
    if gone := [s for s in strata if s not in rows.columns]:
        raise ValueError(f"no field {gone}; there are {sorted(rows.columns)}")
    return F.concat_ws("|", F.coalesce("kind", F.lit("?")), *[F.concat(F.lit(f"{s}="), F.coalesce(F.col(s).cast("string"), F.lit("none"))) for s in strata])


def stale(results: DataFrame, live: DataFrame) -> DataFrame:
    """run, reason of stored results that must not be scored: their corpus or index is not what lies there now. results:
    run, corpus, corpus_digest, written; live: corpus, digest, changed."""
    joined = results.join(live, "corpus", "left")
    reason = F.when(F.col("digest").isNull(), "corpus is gone").when(F.col("corpus_digest") != F.col("digest"), "corpus has changed").when(F.col("written") < F.col("changed"), "index is older")
    return joined.select("run", reason.alias("reason")).where("reason IS NOT NULL")


def envelope(files: DataFrame, chunks: DataFrame, stages: DataFrame) -> DataFrame:
    """One row on a build: n_files, n_chunks, bytes_indexed, accounted_ms."""
    a = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_indexed"))
    return a.crossJoin(chunks.agg(F.count("*").alias("n_chunks"))).crossJoin(stages.agg(F.coalesce(F.sum("ms"), F.lit(0.0)).alias("accounted_ms")))
