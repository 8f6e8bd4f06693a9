"""The search as one plan: phrases, lexical and semantic lists, fusion, boosts, pins, candidates, hits.

Queries are rows (query_id, raw), so one pass over the corpus serves any number of them. Text stays out of the ranking
frames and is joined to the candidates at the end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.frames import settled
from quarry.functions.text import phrase_array, split_phrases, under
from quarry.operators import display, exact, fusion, lexical, semantic
from quarry.operators.chunking import ChunkParams, chunks
from quarry.operators.finalize import HITS, Finalize, hits
from quarry.operators.lexical import KEY
from quarry.sources.corpus import scoped

POOL = 128
MODES = ("keyword", "bm25", "semantic", "hybrid")


@dataclass(frozen=True)
class SearchOptions:
    mode: str = "semantic"
    k: int = 5
    prefix: str = ""
    paths: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    chunk: ChunkParams = field(default_factory=ChunkParams)
    sem_weight: float = 0.2
    decl_boost: float = 0.5
    path_boost: float = 0.0
    bm25_pin: int = 5
    bridge: int = 0
    bridge_weight: float = 0.4
    prf: int = 0
    maxsim: bool = False
    maxsim_pool: int | None = None
    maxsim_blend: float = 0.5
    maxsim_post: bool = False
    sif: bool = False
    sif_center: bool = False
    sif_idf: bool = False
    file_window: int = 0
    lines: tuple[int, int] | None = None
    tail: Finalize = field(default_factory=Finalize)
    ignore_case: bool = False
    literal: bool = False
    word: bool = False
    unlimited: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if not 1 <= self.k <= 10_000:
            raise ValueError("k must be 1 to 10,000")

    @property
    def width(self) -> int:
        return 2 * max(POOL, self.k)

    @property
    def lexical(self) -> bool:
        """Whether anything reads the lexical list."""
        return self.mode in ("bm25", "hybrid") or self.bm25_pin > 0 or self.bridge > 0

    @property
    def weighting(self) -> str:
        """What a search must share with the vectors of an index."""
        return f"sif{'-idf' * self.sif_idf}{'-centred' * self.sif_center}" if self.sif else "plain"

    def for_file(self) -> SearchOptions:
        """The options of a search whose scope is a single file: windows of file_window lines, no limit on the pool.
        Definition chunks stay as they are, and 0 leaves all as it is."""
        if self.file_window < 1 or self.chunk.function_cap:
            return self
        return replace(self, chunk=self.chunk.with_window(self.file_window), unlimited=True)

    def widened(self) -> SearchOptions:
        """Options that fetch more hits than asked for, so that a filter on their lines leaves k."""
        return replace(self, k=min(max(20 * self.k, 200), 2000), lines=None) if self.lines else self


@dataclass(frozen=True)
class Tables:
    """What a search reads: chunks with their text, their tokens, term statistics, vectors, and what weighs tokens."""

    chunks: DataFrame
    tokens: DataFrame
    vectors: DataFrame
    weights: semantic.Weights | None = None
    terms: lexical.Store | None = None

    def store(self) -> lexical.Store:
        return self.terms or lexical.Store(self.tokens)

    def kept(self) -> Tables:
        """The same tables, tokens cached: several stages of a search read them. The cache spills to disk, is computed
        again where an executor is lost, and is dropped by release()."""
        self.tokens.persist()
        return self

    def release(self) -> None:
        self.tokens.unpersist()


def resolve_mode(pattern: bool, mode: str | None) -> tuple[str, str]:
    """(mode, why): a pattern asks for exact search whatever the mode; without either it is semantic."""
    if pattern:
        return "keyword", "pattern given"
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return (mode, "mode given") if mode else ("semantic", "default")


def tables(files: DataFrame, options: SearchOptions) -> Tables:
    """The tables of a corpus, computed from its files."""
    cut = chunks(files, options.chunk)
    tokens = lexical.chunk_tokens(cut)
    weights = semantic.weights_of(tokens, options.sif_idf, options.sif_center) if options.sif else None
    return Tables(cut, tokens, semantic.chunk_vectors(tokens, weights=weights), weights)


def phrases_of(queries: DataFrame) -> DataFrame:
    """query_id, phrases: up to eight of each query."""
    return queries.select("query_id", phrase_array(F.col("raw")).alias("phrases"))


def candidates(t: Tables, queries: DataFrame, options: SearchOptions) -> DataFrame:
    """query_id, rank, path, start_line, score, phrases, bm25_rank, decl_share, path_share: the pool of each query.

    A phrase is ranked like a query of its own, under query_id * 8 + its number; phrases then merge by turns.
    """
    asked = phrases_of(queries).select("query_id", F.posexplode("phrases").alias("p", "phrase")).select((F.col("query_id") * 8 + F.col("p")).alias("query_id"), "phrase")
    # under every ranking: a narrow scope still fills its pool, while statistics stay those of the whole corpus
    allow = under(F.col("path"), options.prefix)
    terms, most = t.store(), 1 << 30 if options.unlimited else POOL
    wanted = settled(lexical.query_terms(asked))
    if options.lexical:
        if options.prf:
            wanted = wanted.unionByName(lexical.prf_terms(terms, asked, options.prf).select("query_id", "term", F.lit(1.0).alias("weight")))
        if options.bridge:
            more = lexical.bridge_terms(terms, asked, options.bridge).select("query_id", "term", F.lit(options.bridge_weight).alias("weight"))
            wanted = wanted.unionByName(more)
        lex = lexical.bm25(terms, asked, most, options.prefix, weighted=wanted)
    else:
        lex = t.tokens.sparkSession.createDataFrame([], "query_id long, path string, start_line int, score double, rank int")
    lex = settled(lex)  # at most POOL rows a phrase; four stages read it
    sem = None
    if options.mode in ("semantic", "hybrid"):
        sem = semantic.nearest(t.vectors, semantic.query_vectors(asked, t.weights), most, KEY, allow)
        if options.maxsim and not options.maxsim_post:
            sem = semantic.max_sim_rerank(sem, t.tokens, asked, options.k, options.maxsim_pool, options.maxsim_blend, t.weights)
    ranking = fusion.fuse(lex, sem if sem is not None else lex.withColumn("distance", 1 - F.col("score")), options.mode, options.sem_weight, 2 * most if options.unlimited else options.width)
    if options.maxsim and options.maxsim_post:
        # scores grow with merit, distances shrink: the sign turns on the way in and again on the way out
        ranking = semantic.max_sim_rerank(ranking.withColumn("distance", -F.col("score")), t.tokens, asked, options.k, options.maxsim_pool, options.maxsim_blend, t.weights)
        ranking = ranking.select("query_id", "rank", *KEY, (-F.col("distance")).alias("score"))
    ranking = settled(ranking.select("query_id", "rank", *KEY, "score"))
    head = 6 * options.k
    near = ranking.where(F.col("rank") <= head).select(*KEY).distinct()
    declared = display.declared(t.chunks.join(near, KEY, "left_semi")) if options.decl_boost else None
    ranking = fusion.boosted(ranking, asked, declared, head, options.decl_boost, options.path_boost)
    pool = fusion.candidates(fusion.pinned(ranking, lex, options.bm25_pin), lex, options.k, options.bm25_pin)
    split = pool.select(F.floor(F.col("query_id") / 8).cast("long").alias("query_id"), (F.col("query_id") % 8).cast("int").alias("p"), "rank", *KEY, "score", "bm25_rank", "decl_share", "path_share")
    carried = split.groupBy("query_id", *KEY).agg(F.min("bm25_rank").alias("bm25_rank"), F.max("decl_share").alias("decl_share"), F.max("path_share").alias("path_share"))
    return fusion.merge_phrases(split.select("query_id", "p", "rank", *KEY, "score")).join(carried, ["query_id", *KEY])


def search_tables(t: Tables, queries: DataFrame, options: SearchOptions) -> DataFrame:
    """HITS of each query over built tables. A filter on lines works on more hits than asked for and keeps the first k."""
    if options.lines:
        low, high = options.lines
        found = search_tables(t, queries, options.widened()).where(F.col("line").between(low, high))
        again = Window.partitionBy("query_id").orderBy("rank")
        return found.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= options.k)
    # a bounded head: sent to the chunks, whose text would be shuffled otherwise
    pool = settled(candidates(t, queries, options)).join(t.chunks, KEY)
    pool = pool.withColumn("decl_share", F.coalesce("decl_share", F.lit(0.0))).withColumn("path_share", F.coalesce("path_share", F.lit(0.0)))
    return hits(pool, phrases_of(queries), replace(options.tail, k=options.k, bm25_pin=options.bm25_pin))


def search(files: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Hits of each query over files. keyword mode takes raw as a pattern of one query."""
    if options.mode == "keyword":
        pattern = queries.first()
        if pattern is None or not pattern.raw:
            raise ValueError("the query is empty")
        found = exact.search(scoped(files, options.prefix, list(options.paths), list(options.globs)), pattern.raw, literal=options.literal, ignore_case=options.ignore_case, word=options.word)
        if options.lines:
            found = found.where(F.col("line_no").between(*options.lines))
        return found.select(F.lit(pattern.query_id).alias("query_id"), "path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line_no").alias("line"), F.col("line").alias("text"), F.lit(1.0).alias("score"))
    files = scoped(files, "", list(options.paths), list(options.globs))
    return search_tables(tables(files, options).kept(), queries, options)


def search_one(spark: SparkSession, files: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    if not query.strip():
        raise ValueError("the query is empty")
    return search(files, spark.createDataFrame([(0, query)], "query_id long, raw string"), options)


def report(found: DataFrame, query: str) -> DataFrame:
    """One row: hits, files, phrases without a hit, the best score."""
    n = len(split_phrases(query))
    shown = found.agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"), F.max("score").alias("best_score"), F.array_sort(F.collect_set("phrase")).alias("shown"))
    return shown.withColumn("missed_phrases", F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.col("shown"))).drop("shown")


def suggestion(files: DataFrame, pattern: str, t: Tables | None = None, k: int = 3) -> DataFrame:
    """What a ranked search has for a pattern that nothing matches: its first k hits by meaning; no row where a tree has
    no index (t), since a cold search is more than a hint is worth."""
    spark = files.sparkSession
    words = " ".join(re.findall(r"[^\W_]+", pattern))
    if t is None or not words:
        return spark.createDataFrame([], HITS)
    return search_tables(t, spark.createDataFrame([(0, words)], "query_id long, raw string"), SearchOptions(mode="semantic", k=k))
