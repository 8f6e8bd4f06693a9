"""Named queries over the driver's tables, with the SQL that must give the same rows.

Queries run over whole tables. Columns of doubles are rounded to six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import frames
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.functions.frames import settled
from quarry.operators import chunking, display, drift, evaluation, exact, finalize, fusion, lexical, passes, semantic
from quarry.operators.lexical import KEY
from quarry.plans import oracles as O
from quarry.plans.search import SearchOptions, report, search
from quarry.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The queries that the registered searches ask.
ASKED = [(1, "there is a thing of the"), (2, "der die und"), (3, "getUserName licensed version"), (4, "unknownword"), (5, "de la ción token token")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_documents(corpus.spread(table(spark, sf_dir, "documents")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.window_chunks(files(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.chunk_tokens(chunks(spark, sf_dir))


def asked(spark: SparkSession, name: str = "phrase") -> DataFrame:
    return spark.createDataFrame(ASKED, f"query_id long, {name} string")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Sources and scopes


@query(O.with_(O.FILES, select="SELECT path, size, mtime FROM files"))
def walk_files(spark, sf_dir):
    return files(spark, sf_dir).select("path", "size", "mtime")


@query("SELECT 'pages/' || page_id || '.html' AS path, strlen(html)::BIGINT AS size FROM pages UNION ALL SELECT concat_ws('/', 'conv', conv_id::VARCHAR, turn || '_' || role || '.txt'), strlen(text)::BIGINT FROM conversations")
def walk_other_sources(spark, sf_dir):
    pages = corpus.from_pages(table(spark, sf_dir, "pages"))
    return pages.unionByName(corpus.from_conversations(table(spark, sf_dir, "conversations"))).select("path", "size")


@query(O.with_(O.FILES, select="SELECT path FROM files WHERE path = 'en/src1' OR path LIKE 'en/src1/%'"))
def scope_filter(spark, sf_dir):
    return corpus.scoped(files(spark, sf_dir), "en/src1").select("path")


@query(O.with_(O.FILES, select="SELECT path FROM files WHERE path LIKE 'de/%' OR path LIKE 'fr/src2/%'"))
def path_list_filter(spark, sf_dir):
    return corpus.scoped(files(spark, sf_dir), paths=["de", "fr/src2"]).select("path")


@query(O.with_(O.FILES, select=r"SELECT path FROM files WHERE regexp_matches(path, '^(.*/)?[^/]*7\.txt$') AND NOT regexp_matches(path, '^es/')"))
def glob_filter(spark, sf_dir):
    return corpus.scoped(files(spark, sf_dir), globs=["*7.txt", "!/es"]).select("path")


@query(O.with_(O.FILES, select="SELECT path, size FROM files WHERE size <= 4096"))
def size_filter(spark, sf_dir):
    return corpus.scoped(files(spark, sf_dir), max_bytes=4096).select("path", "size")


@query(O.with_(O.FILES, O.LS, O.LINES, select="SELECT path, line_no, line FROM lines"))
def lines_of_document(spark, sf_dir):
    return corpus.lines(files(spark, sf_dir))


@query(O.with_(O.FILES, O.LS, O.LINES, select="SELECT path, line_no FROM lines WHERE line_no BETWEEN 3 AND 5"))
def line_range_filter(spark, sf_dir):
    low, high = T.parse_lines("3-5")
    return corpus.lines(files(spark, sf_dir)).where(F.col("line_no").between(low, high)).select("path", "line_no")


@query(O.with_(O.FILES, O.LS, select="SELECT path, 2 AS start_line, 4 AS end_line, array_to_string(ls[2:4], chr(10)) AS body FROM ls"))
def read_spans(spark, sf_dir):
    f = files(spark, sf_dir)
    return corpus.read_lines(f, f.select("path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line")))


# Exact search

_EXACT = (O.FILES, O.LS, O.LINES)


@query(O.with_(*_EXACT, select="SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'th[a-z]+ing')"))
def exact_regex(spark, sf_dir):
    return exact.search(files(spark, sf_dir), "th[a-z]+ing")


@query(O.with_(*_EXACT, select="SELECT path, line_no, line FROM lines WHERE contains(line, 'License, Version 2.0')"))
def exact_literal(spark, sf_dir):
    return exact.search(files(spark, sf_dir), "License, Version 2.0", literal=True)


@query(O.with_(*_EXACT, select="SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '(?i)licensed')"))
def exact_ignore_case(spark, sf_dir):
    return exact.search(files(spark, sf_dir), "licensed", ignore_case=True)


@query(O.with_(*_EXACT, select=r"SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '(^|[^\p{L}\p{M}\p{N}_])that($|[^\p{L}\p{M}\p{N}_])')"))
def exact_word(spark, sf_dir):
    return exact.search(files(spark, sf_dir), "that", word=True)


@query(O.with_(*_EXACT, select="SELECT path, count(*) AS n FROM lines WHERE contains(line, 'tion') GROUP BY path"))
def exact_count_per_file(spark, sf_dir):
    return exact.per_file(exact.search(files(spark, sf_dir), "tion", literal=True))


@query(O.with_(*_EXACT, select="SELECT count(*) AS total, count(DISTINCT path) AS files FROM lines WHERE contains(line, 'tion')"))
def exact_totals(spark, sf_dir):
    return exact.totals(exact.search(files(spark, sf_dir), "tion", literal=True))


@query(O.with_(*_EXACT, select="SELECT path, line_no, line FROM lines WHERE contains(line, 'tion') ORDER BY path, line_no, line LIMIT 250"))
def exact_retained_head(spark, sf_dir):
    return exact.head(exact.search(files(spark, sf_dir), "tion", literal=True))


@query(O.with_(*_EXACT, select="SELECT path, min(line_no) AS first_line FROM lines WHERE contains(line, 'token') GROUP BY path"))
def files_with_matches(spark, sf_dir):
    return exact.search(files(spark, sf_dir), "token", literal=True).groupBy("path").agg(F.min("line_no").alias("first_line"))


@query(O.with_(*_EXACT, "hit AS (SELECT path, line_no FROM lines WHERE contains(line, 'token'))", "near AS (SELECT l.path, l.line_no, l.line, max(CASE WHEN h.line_no = l.line_no THEN 1 ELSE 0 END) = 1 AS is_hit FROM lines l JOIN hit h ON h.path = l.path AND abs(h.line_no - l.line_no) <= 2 GROUP BY ALL)", "gap AS (SELECT *, CASE WHEN line_no - lag(line_no, 1, -1) OVER (PARTITION BY path ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS new FROM near)", select="SELECT path, line_no, line, is_hit, sum(new) OVER (PARTITION BY path ORDER BY line_no)::BIGINT AS block FROM gap"))
def exact_context_blocks(spark, sf_dir):
    f = files(spark, sf_dir)
    return exact.context(f, exact.search(f, "token", literal=True))


# Chunks and tokens


@query(O.with_(O.FILES, O.LS, O.CHUNKS, select="SELECT path, start_line, end_line, md5(body) AS body_md5 FROM chunks"))
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir).select("path", "start_line", "end_line", F.md5("body").alias("body_md5"))


@query(O.with_(O.FILES, O.LS, select="SELECT path, a::INT AS start_line, least(a + 6, len(ls))::INT AS end_line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1, 7)) AS a FROM ls)"))
def chunk_gap_cuts(spark, sf_dir):
    spans = files(spark, sf_dir).select("path", F.lit(1).alias("start_line"), F.size(corpus.line_array(F.col("text"))).alias("end_line"))
    return chunking.gap_chunks(spans, 7)


@query()
def chunk_budget(spark, sf_dir):
    return chunking.budget_chunks(files(spark, sf_dir), chunking.ChunkParams(budget=800)).select("path", "start_line", "end_line")


@query()
def def_chunks(spark, sf_dir):
    return chunking.definition_chunks(files(spark, sf_dir)).select("path", "start_line", "end_line")


@query(f"SELECT doc_id, {O.tokens('text')} AS tokens FROM documents")
def tokenize_code_aware(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT DISTINCT w AS word, array_to_string(string_split(regexp_replace(regexp_replace(w, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' '), '|') AS parts FROM (SELECT unnest(regexp_extract_all(url, '[\p{L}\p{N}]+')) AS w FROM pages)")
def split_camel(spark, sf_dir):
    words = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("url", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(T.split_camel(F.col("word")), "|").alias("parts"))


@query(O.with_(*O.BASE[:5], select="SELECT path, start_line, dl, term, tf FROM terms"))
def term_freq(spark, sf_dir):
    return lexical.chunk_terms(tokens(spark, sf_dir))


@query(O.with_(*O.BASE[:6], select="SELECT term, df FROM stats"))
def doc_freq(spark, sf_dir):
    return lexical.term_stats(lexical.chunk_terms(tokens(spark, sf_dir)))


@query(O.with_(*O.BASE[:4], select="SELECT path, start_line, len(tokens)::BIGINT AS dl FROM tok"))
def doc_len(spark, sf_dir):
    return tokens(spark, sf_dir).select(*KEY, F.size("tokens").cast("long").alias("dl"))


@query(O.with_(*O.BASE, select="SELECT n_docs, total_len, round(avgdl, 6) AS avgdl FROM corpus"))
def corpus_stats(spark, sf_dir):
    return rounded(lexical.corpus_stats(tokens(spark, sf_dir)), "avgdl")


# Lexical ranking

_BM25 = (*O.BASE, O.queries(ASKED), O.QTERMS)
_HIT = "SELECT query_id, rank, path, start_line, round(score, 6) AS score FROM "


def _hit(df: DataFrame) -> DataFrame:
    return rounded(df.select("query_id", "rank", *KEY, "score"), "score")


@query(O.with_(*O.BASE, O.queries(ASKED[:1]), O.QTERMS, O.scored(), O.ranked("scored", "top", 20), select=_HIT + "top"))
def bm25_topk(spark, sf_dir):
    return _hit(lexical.bm25(tokens(spark, sf_dir), asked(spark).where("query_id = 1"), 20))


@query(O.with_(*_BM25, O.scored(), O.ranked("scored", "top", 128), select=_HIT + "top"))
def bm25_batch(spark, sf_dir):
    return _hit(lexical.bm25(tokens(spark, sf_dir), asked(spark)))


@query(O.with_(*_BM25, O.scored(scope="path LIKE 'en/src1/%'"), O.ranked("scored", "top", 20), select=_HIT + "top"))
def bm25_scoped(spark, sf_dir):
    return _hit(lexical.bm25(tokens(spark, sf_dir), asked(spark), 20, "en/src1"))


@query(O.with_(*O.BASE, "wanted AS (SELECT * FROM (VALUES (1::BIGINT, 'the', 0.5::DOUBLE), (1, 'thing', 2), (1, 'nicht', 0.25)) v(query_id, term, weight))", O.scored(wanted="wanted"), O.ranked("scored", "top", 20), select=_HIT + "top"))
def bm25_weighted(spark, sf_dir):
    wanted = spark.createDataFrame([(1, "the", 0.5), (1, "thing", 2.0), (1, "nicht", 0.25)], "query_id long, term string, weight double")
    return _hit(lexical.bm25(tokens(spark, sf_dir), asked(spark), 20, weighted=wanted))


@query(O.with_(*_BM25, O.scored(scope="path LIKE 'de/%'"), O.ranked("scored", "top", 20), select=_HIT + "top"))
def bm25_partial_store(spark, sf_dir):
    every = tokens(spark, sf_dir)
    delta = F.col("path").startswith("de/")
    return _hit(lexical.bm25(every.where(delta), asked(spark), 20, base=every.where(~delta)))


_PRF = (*_BM25, O.scored(), O.ranked("scored", "top", 10), "fb AS (SELECT t.query_id, m.term, sum(m.tf) AS tf FROM top t JOIN terms m USING (path, start_line) WHERE strlen(m.term) >= 3 GROUP BY ALL)", f"rated AS (SELECT fb.query_id, fb.term, fb.tf * {O.IDF} AS score FROM fb JOIN stats USING (term), corpus WHERE NOT EXISTS (SELECT 1 FROM qterms q WHERE q.query_id = fb.query_id AND q.term = fb.term))", O.ranked("rated", "more", 5, "round(score, 9) DESC, term"))


@query(O.with_(*_PRF, select="SELECT query_id, rank, term, round(score, 6) AS score FROM more"))
def prf_terms(spark, sf_dir):
    return rounded(lexical.prf_terms(tokens(spark, sf_dir), asked(spark)), "score")


@query(O.with_(*_PRF, "wide AS (SELECT query_id, term, weight FROM qterms UNION ALL SELECT query_id, term, 1 FROM more)", O.scored("second", "wide"), O.ranked("second", "again", 20), select=_HIT + "again"))
def prf_second_pass(spark, sf_dir):
    return _hit(lexical.prf(tokens(spark, sf_dir), asked(spark), 5, 20))


_RARE = "rare AS (SELECT query_id, term, ln(n_docs / df) AS w FROM qterms JOIN stats USING (term), corpus WHERE df <= greatest(floor(n_docs * 0.2), 8))"
_CODE = O.FILES.replace("'.txt'", "CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.py' ELSE '' END")
_BRIDGE = (_CODE, *_BM25[1:], _RARE, "able AS (SELECT query_id FROM rare GROUP BY query_id HAVING count(*) >= 2)", "held AS (SELECT query_id, path, count(*) AS n, sum(w) AS score FROM (SELECT DISTINCT query_id, path, term, w FROM terms JOIN rare USING (term) JOIN able USING (query_id) WHERE path NOT LIKE '%.txt') GROUP BY query_id, path HAVING count(*) >= 2)", O.ranked("held", "near", 5, "round(score, 9) DESC, path"))


def _code(spark, sf_dir):
    """Tokens of the documents as files of three kinds, of which expansions learn from two."""
    f = files(spark, sf_dir)
    kind = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long") % 3
    stem = F.regexp_replace("path", r"\.txt$", "")
    path = F.when(kind == 0, F.col("path")).when(kind == 1, F.concat(stem, F.lit(".py"))).otherwise(stem)
    return lexical.chunk_tokens(chunking.window_chunks(f.withColumn("path", path)))


@query(O.with_(*_BRIDGE, select="SELECT query_id, rank, path, round(score, 6) AS score FROM near"))
def bridge_files(spark, sf_dir):
    return rounded(lexical.bridge_files(_code(spark, sf_dir), asked(spark)), "score")


@query(O.with_(*_BRIDGE, "cand AS (SELECT n.query_id, t.term, count(DISTINCT t.path) AS n_files FROM near n JOIN terms t USING (path) WHERE strlen(t.term) >= 3 GROUP BY ALL HAVING count(DISTINCT t.path) >= 2)", "rated AS (SELECT c.query_id, c.term, n_files * ln(n_docs / df) AS score FROM cand c JOIN stats USING (term), corpus WHERE df <= greatest(floor(n_docs * 0.2), 8) AND NOT EXISTS (SELECT 1 FROM qterms q WHERE q.query_id = c.query_id AND q.term = c.term))", O.ranked("rated", "more", 5, "round(score, 9) DESC, term"), select="SELECT query_id, rank, term, round(score, 6) AS score FROM more"))
def bridge_terms(spark, sf_dir):
    return rounded(lexical.bridge_terms(_code(spark, sf_dir), asked(spark)), "score")


# Vectors

_NORMED = "u AS (SELECT vec_id, label, " + O.UNIT.format(v="embedding") + " AS v FROM embeddings)"
_QUANTED = "z AS (SELECT vec_id, label, " + O.QUANT.format(v="v") + " AS q FROM u)"
_I8 = "1 - list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1]::INT * p[2]::INT)) / (127.0::DOUBLE * 127.0::DOUBLE)"


def _vectors(spark, sf_dir):
    return corpus.spread(table(spark, sf_dir, "embeddings")).select("vec_id", "label", V.normalize(F.col("embedding")).alias("v"))


@query(O.with_(_NORMED, _QUANTED, select="SELECT vec_id, q FROM z"))
def vector_normalize_quantize(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", V.quantize(F.col("v")).alias("q"))


@query(O.with_("pairs AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)", select="SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id)::INT AS rank FROM pairs) WHERE rank <= 10"))
def cosine_topk(spark, sf_dir):
    rows = corpus.spread(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")))
    return rounded(semantic.nearest_exact(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10, ["vec_id"]), "distance")


def _i8_sql(where: str) -> str:
    return O.with_(_NORMED, _QUANTED, f"pairs AS (SELECT a.vec_id AS query_id, b.vec_id, {_I8} AS distance FROM z a, z b WHERE a.vec_id % 100 = 0 AND {where})", select="SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs) WHERE rank <= 10")


def _i8(spark, sf_dir, allow=None):
    rows = _vectors(spark, sf_dir).select("vec_id", "label", V.quantize(F.col("v")).alias("q"))
    return rounded(semantic.nearest(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "q"), 10, ["vec_id"], allow), "distance")


@query(_i8_sql("true"))
def i8_topk(spark, sf_dir):
    return _i8(spark, sf_dir)


@query(_i8_sql("b.label = 1"))
def i8_topk_scoped(spark, sf_dir):
    return _i8(spark, sf_dir, F.col("label") == 1)


_SIF = ("sif AS (SELECT term, sum(n)::BIGINT AS freq, count(*) AS df FROM (SELECT path, term, count(*) AS n FROM (SELECT path, unnest(tokens) AS term FROM tok) GROUP BY ALL) GROUP BY term)", "w AS (SELECT term, 0.001 / (0.001 + freq / (SELECT sum(freq) FROM sif)) AS w FROM sif)")


@query(O.with_(*O.BASE[:4], *_SIF, select="SELECT term, freq, df, round(w, 6) AS w FROM sif JOIN w USING (term)"))
def sif_weights(spark, sf_dir):
    stats = semantic.sif_terms(tokens(spark, sf_dir))
    return rounded(stats.join(semantic.sif_weights(stats), "term"), "w")


def _pool_sql(weight: str, join: str) -> str:
    """The pooled vectors of all chunks."""
    parts = ", ".join(f"sum(n * {weight} * {O.hash_component('term', repr(str(d)))}) / sum(n * {weight}) AS v{d}" for d in range(32))
    norm = " + ".join(f"v{d} * v{d}" for d in range(32))
    return f"counts AS (SELECT path, start_line, term, count(*) AS n FROM (SELECT path, start_line, unnest(tokens) AS term FROM tok) GROUP BY ALL)", f"raw AS (SELECT path, start_line, {parts} FROM counts {join} GROUP BY path, start_line)", "SELECT path, start_line, " + ", ".join(f"round(v{d} / sqrt({norm}), 6) AS v{d}" for d in range(32)) + " FROM raw"


def _pooled(spark, sf_dir, weighted: bool):
    every = tokens(spark, sf_dir)
    weights = semantic.weights_of(every) if weighted else None
    v = semantic.pooled(every, weights=weights)
    return v.select(*KEY, *[F.round(F.get("v", F.lit(d)), 6).alias(f"v{d}") for d in range(32)])


@query(O.with_(*O.BASE[:4], *_pool_sql("1.0", "")[:2], select=_pool_sql("1.0", "")[2]))
def pooled_vectors(spark, sf_dir):
    return _pooled(spark, sf_dir, False)


@query(O.with_(*O.BASE[:4], *_SIF, *_pool_sql("w", "JOIN w USING (term)")[:2], select=_pool_sql("w", "JOIN w USING (term)")[2]))
def sif_pooled(spark, sf_dir):
    return _pooled(spark, sf_dir, True)


# Fusion of the lexical and the semantic list

_TWO = (*_BM25, O.scored(), O.ranked("scored", "lex", 128), *O.SEMANTIC)
_FUSED = "fused AS (SELECT query_id, path, start_line, sum(s) AS score FROM (SELECT query_id, path, start_line, 1.0::DOUBLE / (60 + rank) AS s FROM lex UNION ALL SELECT query_id, path, start_line, 0.2::DOUBLE / (60 + rank) FROM sem) GROUP BY ALL)"


def _two(spark, sf_dir):
    every = tokens(spark, sf_dir)
    vectors = semantic.chunk_vectors(every)
    return lexical.bm25(every, asked(spark)), semantic.nearest(vectors, semantic.query_vectors(asked(spark)), 128, KEY)


@query(O.with_(*_BM25, *O.SEMANTIC, select="SELECT query_id, rank, path, start_line, round(distance, 6) AS distance FROM sem"))
def semantic_topk(spark, sf_dir):
    return rounded(_two(spark, sf_dir)[1], "distance")


@query(O.with_(*_TWO, _FUSED, O.ranked("fused", "out", 256), select="SELECT query_id, rank, path, start_line, round(score, 9) AS score FROM out"))
def rrf_hybrid(spark, sf_dir):
    lex, sem = _two(spark, sf_dir)
    return fusion.fuse(lex, sem).select("query_id", "rank", *KEY, F.round("score", 9).alias("score"))


@query(O.with_(*_TWO, "floor AS (SELECT query_id, min(1 - distance) AS f, max(rank) AS l FROM sem GROUP BY query_id)", "miss AS (SELECT query_id, path, start_line, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM lex WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM sem s WHERE s.query_id = lex.query_id AND s.path = lex.path AND s.start_line = lex.start_line))", select="SELECT query_id, rank, path, start_line, round(1 - distance, 6) AS score FROM sem UNION ALL SELECT query_id, (coalesce(l, 0) + i)::INT, path, start_line, round(coalesce(f, 0) - 0.001 * i, 6) FROM miss LEFT JOIN floor USING (query_id)"))
def pins_appended(spark, sf_dir):
    lex, sem = _two(spark, sf_dir)
    return _hit(fusion.pinned(fusion.fuse(lex, sem, "semantic"), lex))


_TAIL = r"regexp_extract(path, '([^/]+/[^/]+)$', 1)"


_MINE = f"list_distinct({O.tokens('phrase')})"


@query(O.with_(*_BM25, O.scored(), O.ranked("scored", "top", 128), f"shared AS (SELECT top.*, CASE WHEN rank <= 30 THEN len(list_intersect({_MINE}, {O.tokens(_TAIL)})) / len({_MINE}) ELSE 0 END AS path_share, CASE WHEN rank <= 30 THEN len(list_intersect({_MINE}, tok.tokens[6:25])) / len({_MINE}) ELSE 0 END AS decl_share FROM top JOIN queries USING (query_id) JOIN tok USING (path, start_line))", "b AS (SELECT query_id, path, start_line, rank AS was, path_share, decl_share, score * (1 + 0.5 * decl_share) * (1 + 0.5 * path_share) AS score FROM shared)", select="SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, was)::INT AS rank, path, start_line, round(score, 6) AS score, round(path_share, 6) AS path_share, round(decl_share, 6) AS decl_share FROM b"))
def structural_boost(spark, sf_dir):
    """The documents declare nothing, so twenty tokens of each chunk stand for what it declares."""
    every = tokens(spark, sf_dir)
    ranking = lexical.bm25(every, asked(spark)).select("query_id", "rank", *KEY, "score")
    declared = every.select(*KEY, F.slice("tokens", 6, 20).alias("tokens"))
    out = fusion.boosted(ranking, asked(spark), declared, 30, path=0.5)
    return rounded(out.select("query_id", "rank", *KEY, "score", "path_share", "decl_share"), "score", "path_share", "decl_share")


@query(O.with_(*_TWO, "top16 AS (SELECT query_id, path, start_line, rank AS bm25_rank FROM lex WHERE rank <= 16)", select="SELECT query_id, rank, path, start_line, bm25_rank FROM sem LEFT JOIN top16 USING (query_id, path, start_line) WHERE rank <= 30 OR bm25_rank <= 5"))
def candidate_selection(spark, sf_dir):
    lex, sem = _two(spark, sf_dir)
    return fusion.candidates(fusion.fuse(lex, sem, "semantic"), lex, 5).select("query_id", "rank", *KEY, "bm25_rank")


@query(O.with_(*_TWO, "ps AS (SELECT query_id, 0 AS p, rank, path, start_line, score FROM lex WHERE rank <= 20 UNION ALL SELECT query_id, 1, rank, path, start_line, 1 - distance FROM sem WHERE rank <= 20)", "fl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, p) AS turn, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM ps WINDOW w AS (PARTITION BY query_id, p))", "m AS (SELECT query_id, path, start_line, min(turn) AS turn, arg_min(s, turn) AS score, bit_or((1 << p)::INT) AS phrases FROM fl GROUP BY ALL)", select="SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn)::INT AS rank, path, start_line, round(score, 6) AS score, phrases FROM m"))
def phrase_interleave(spark, sf_dir):
    lex, sem = _two(spark, sf_dir)
    part = lambda df, p: df.where("rank <= 20").select("query_id", F.lit(p).alias("p"), "rank", *KEY, "score")
    return rounded(fusion.merge_phrases(part(lex, 0).unionByName(part(fusion.fuse(lex, sem, "semantic"), 1))), "score")


@query(r"SELECT item_id, list_transform(list_filter(list_transform(string_split(regexp_replace(text, '\s+', '|', 'g'), '|'), lambda x: trim(x)), lambda x: x <> '')[1:8], lambda x: x) AS phrases FROM benchmark")
def phrase_split(spark, sf_dir):
    raw = F.regexp_replace("text", r"[ \t\n\f\r]+", "|")
    return table(spark, sf_dir, "benchmark").select("item_id", T.phrase_array(raw).alias("phrases"))


_SIM = (
    *_BM25, O.scored(), O.ranked("scored", "head", 30),
    f"qv AS (SELECT query_id, term AS qt, list_transform(range(32), lambda d: {O.hash_component('term', 'd::VARCHAR')}) AS v FROM qterms)",
    "ct AS (SELECT DISTINCT path, start_line, term FROM terms WHERE (path, start_line) IN (SELECT (path, start_line) FROM head))",
    f"tv AS (SELECT term, list_transform(range(32), lambda d: {O.hash_component('term', 'd::VARCHAR')}) AS v FROM (SELECT DISTINCT term FROM ct))",
    "s AS (SELECT query_id, qt, term, list_cosine_similarity(qv.v, tv.v) AS s FROM qv, tv)",
    "best AS (SELECT h.query_id, h.path, h.start_line, s.qt, max(s.s) AS s FROM head h JOIN ct USING (path, start_line) JOIN s ON s.term = ct.term AND s.query_id = h.query_id GROUP BY ALL)",
    "sims AS (SELECT query_id, path, start_line, sum(s) AS sim FROM best GROUP BY ALL)",
)


@query(O.with_(*_SIM, select="SELECT query_id, path, start_line, round(sim, 6) AS sim FROM head LEFT JOIN sims USING (query_id, path, start_line)"))
def maxsim_scores(spark, sf_dir):
    every = tokens(spark, sf_dir)
    head = lexical.bm25(every, asked(spark), 30).select("query_id", *KEY)
    return rounded(semantic.max_sim(head, every, asked(spark)), "sim")


@query(O.with_(*_BM25, O.scored(), O.ranked("scored", "head", 40), *_SIM[-6:], "m AS (SELECT query_id, path, start_line, sim, 1 - (1 - score / 100) AS near FROM head LEFT JOIN sims USING (query_id, path, start_line))", "s AS (SELECT *, CASE WHEN max(sim) OVER w > min(sim) OVER w THEN (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) ELSE 0 END AS a, CASE WHEN max(near) FILTER (WHERE sim IS NOT NULL) OVER w > min(near) FILTER (WHERE sim IS NOT NULL) OVER w THEN (near - min(near) FILTER (WHERE sim IS NOT NULL) OVER w) / (max(near) FILTER (WHERE sim IS NOT NULL) OVER w - min(near) FILTER (WHERE sim IS NOT NULL) OVER w) ELSE 0 END AS b FROM m WINDOW w AS (PARTITION BY query_id))".replace("s AS (SELECT *", "spans AS (SELECT *"), "d AS (SELECT query_id, path, start_line, CASE WHEN sim IS NULL THEN 1.0 ELSE -(0.5 * a + 0.5 * b) END AS distance FROM spans)", select="SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), path, start_line)::INT AS rank, path, start_line, round(distance, 6) + 0.0::DOUBLE AS distance FROM d"))
def maxsim_rerank(spark, sf_dir):
    every = tokens(spark, sf_dir)
    ranking = lexical.bm25(every, asked(spark), 40).withColumn("distance", 1 - F.col("score") / 100).select("query_id", "rank", *KEY, "distance")
    return rounded(semantic.max_sim_rerank(ranking, every, asked(spark), 3), "distance")


# The tail of a search


_LOGIT = f"{finalize.BIAS} + CASE WHEN fine IS NULL THEN 0 WHEN hi > lo THEN 0.831619 * (fine - lo) / (hi - lo) ELSE 0.831619 * 0.5 END + -0.583163 * CASE WHEN smax > smin THEN (score - smin) / (smax - smin) ELSE 0.5 END + CASE WHEN b > 0 THEN 1.25367 / b ELSE -0.659836 END + -0.0275815 * bit_count(p) + 0.329578 * decl + 0.468366 * pshare + 2.75082 * height / 32"


@query(f"WITH r AS (SELECT doc_id, doc_id % 23 AS g, CASE WHEN doc_id % 4 <> 0 THEN (doc_id * 37 % 101) / 101.0 END AS fine, (doc_id * 53 % 97) / 7.0 AS score, doc_id % 17 AS b, (1 + doc_id % 7)::INT AS p, (doc_id % 5) / 5.0 AS decl, (doc_id % 3) / 3.0 AS pshare, 6 + doc_id % 27 AS height FROM labels), s AS (SELECT *, min(fine) OVER w AS lo, max(fine) OVER w AS hi, min(score) OVER w AS smin, max(score) OVER w AS smax FROM r WINDOW w AS (PARTITION BY g)), o AS (SELECT doc_id, g, CASE WHEN smax > smin THEN (score - smin) / (smax - smin) ELSE 0.5 END AS rel, 1 / (1 + exp(-({_LOGIT}))) AS odds FROM s) SELECT doc_id, round(0.5 * rel + 0.5 * odds, 6) AS relevance FROM o")
def learned_relevance(spark, sf_dir):
    """The stage of a search itself, over groups of made-up candidates."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select("doc_id", (d % 23).alias("g"), F.when(d % 4 != 0, (d * 37 % 101) / 101.0).alias("fine"), ((d * 53 % 97) / 7.0).alias("score"), (d % 17).alias("b"), (1 + d % 7).cast("int").alias("p"), ((d % 5) / 5.0).alias("decl"), ((d % 3) / 3.0).alias("pshare"), (6 + d % 27).alias("height"))

    def run(pdf):
        pdf = pdf.sort_values("doc_id")
        made = [finalize.Row(str(r.doc_id), 1, int(r.height), [], r.score, int(r.p), int(r.b) or None, r.decl, r.pshare, None if r.fine != r.fine else (1, 1, r.fine, 0)) for r in pdf.itertuples(index=False)]
        order, mixed = finalize.learned(made, [r.score for r in made], 0.5)
        return pd.DataFrame({"doc_id": [int(r.path) for r in order], "relevance": [round(m, 6) for m in mixed]})

    return rows.groupBy("g").applyInPandas(run, "doc_id long, relevance double")


@query("SELECT label, sum(CASE WHEN best < 0.97 THEN 1 << p ELSE 0 END)::INT AS floored FROM (SELECT label, p::INT AS p, max(s) AS best FROM (SELECT label, vec_id % 3 AS p, (vec_id * 31 % 89) / 90.0 AS s FROM embeddings WHERE vec_id % 6 <> 2) GROUP BY ALL) GROUP BY label")
def score_floor(spark, sf_dir):
    """The floor of a search itself, over the best signal of three phrases in each group."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").where(v % 6 != 2).select("label", (v % 3).cast("int").alias("p"), ((v * 31 % 89) / 90.0).alias("s"))
    best = rows.groupBy("label", "p").agg(F.max("s").alias("s"))

    def run(pdf):
        signal = [max(pdf.s[pdf.p == p], default=float("-inf")) for p in range(3)]
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "floored": [finalize.floor_mask(signal, 0.97)]})

    return best.groupBy("label").applyInPandas(run, f"label {dict(rows.dtypes)['label']}, floored int")


def _searched(spark, sf_dir, mode, **more):
    found = search(files(spark, sf_dir), asked(spark, "raw"), SearchOptions(mode=mode, **more))
    return rounded(found.select("query_id", "rank", "path", "start_line", "end_line", "line", "text", "score"), "score")


@query()
def search_bm25(spark, sf_dir):
    return _searched(spark, sf_dir, "bm25")


@query()
def search_semantic(spark, sf_dir):
    return _searched(spark, sf_dir, "semantic")


@query()
def search_hybrid(spark, sf_dir):
    return _searched(spark, sf_dir, "hybrid", bridge=3)


@query()
def search_multi_phrase(spark, sf_dir):
    raw = spark.createDataFrame([(1, "there is a thing|licensed under the|token")], "query_id long, raw string")
    found = search(files(spark, sf_dir), raw, SearchOptions(mode="hybrid", k=10))
    return rounded(found.select("query_id", "rank", "path", "start_line", "end_line", "line", "phrase", "phrases", "score"), "score")


@query(O.with_(*_EXACT, select="SELECT 1::BIGINT AS query_id, path, line_no AS start_line, line_no AS end_line, line_no AS line, line AS text, 1.0::DOUBLE AS score FROM lines WHERE path LIKE 'en/%' AND regexp_matches(line, '[Ll]icensed')"))
def search_keyword(spark, sf_dir):
    raw = spark.createDataFrame([(1, "[Ll]icensed")], "query_id long, raw string")
    return search(files(spark, sf_dir), raw, SearchOptions(mode="keyword", prefix="en"))


@query()
def search_report(spark, sf_dir):
    raw = spark.createDataFrame([(1, "there is a thing|licensed under the|token")], "query_id long, raw string")
    return report(search(files(spark, sf_dir), raw, SearchOptions(mode="bm25", k=10)), "there is a thing|licensed under the|token")


@query()
def hit_passages(spark, sf_dir):
    f = files(spark, sf_dir)
    found = search(f, asked(spark, "raw"), SearchOptions(mode="bm25"))
    shown = display.materialized(found, f)
    return shown.select("query_id", "rank", "path", "lines_from", F.size("lines").alias("n_lines"), display.block(F.col("path"), F.col("unit_rows")).alias("block"), display.record(F.col("path"), F.col("line"), F.col("text")).alias("record"))


@query()
def json_hits(spark, sf_dir):
    return display.json_lines(search(files(spark, sf_dir), asked(spark, "raw"), SearchOptions(mode="bm25")))


@query()
def declared_names(spark, sf_dir):
    return display.declared(chunks(spark, sf_dir)).where(F.size("tokens") > 0)


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || ' [… +' || (length(text) - 200) || ' chars]' ELSE text END AS clipped FROM documents")
def clip_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text")).alias("clipped"))


# Prose rendering


@query(f"SELECT doc_id, array_to_string({O.tokens('text', False)}, ' ') AS prose FROM documents")
def prose_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", T.render_body(F.col("text"), "split")).alias("prose"))


_KW = "'" + "', '".join("""abstract and as async await bool break case catch char class const continue crate def default delete do double elif else enum except extends extern
false final finally float fn for from friend func function goto if impl implements import in inline int interface is lambda let long loop match mod
module mut namespace new nil none not null operator or override package pass private protected pub public raise register return self short signed
sizeof static string struct super switch template then this throw trait true try type typedef typename union unless unsafe unsigned until use using
var virtual void volatile where while with yield begin end""".split()) + "'"


@query(f"SELECT doc_id, array_to_string(list_filter({O.tokens('text', False)}, lambda t: t NOT IN ({_KW}) AND NOT regexp_matches(t, '^[0-9]+$')), ' ') AS prose FROM documents")
def prose_prune_kw(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", T.render_body(F.col("text"), "prune-kw")).alias("prose"))


@query(O.with_(O.FILES, select=f"SELECT path, array_to_string({O.tokens(_TAIL, False)}, ' ') AS rendered FROM files"))
def path_render_tail(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.concat_ws(" ", T.render_path(F.col("path"), "tail")).alias("rendered"))


# Drift and registries: the live tree lost every 7th file, changed every 5th and gained a copy of every 11th

_LIVE = "live AS (SELECT CASE WHEN doc_id % 11 = 3 THEN path || '.new' ELSE path END AS path, size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime FROM (SELECT *, (regexp_extract(path, '([0-9]+)[.]txt$', 1))::BIGINT AS doc_id FROM files) WHERE doc_id % 7 <> 0)"
_DIFF = "diff AS (SELECT coalesce(f.path, l.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM files f FULL JOIN live l ON f.path = l.path WHERE f.path IS NULL OR l.path IS NULL OR f.size <> l.size OR f.mtime <> l.mtime)"


def _live(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("n", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long")).where("n % 7 <> 0")
    path = F.when(F.col("n") % 11 == 3, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return f.select(path.alias("path"), (F.col("size") + (F.col("n") % 5 == 0).cast("long")).alias("size"), "mtime", "text")


@query(O.with_(O.FILES, _LIVE, _DIFF, select="SELECT path, change FROM diff"))
def diff_added_modified_deleted(spark, sf_dir):
    return drift.diff(files(spark, sf_dir), _live(spark, sf_dir))


@query(O.with_(O.FILES, _LIVE, _DIFF, select="SELECT (SELECT count(*) FROM diff) AS dirty, (SELECT count(*) FROM files) AS n_indexed, (SELECT count(*) FROM live) AS n_live, round((SELECT count(*) FROM diff) / greatest((SELECT count(*) FROM files), (SELECT count(*) FROM live)), 6) AS ratio"))
def drift_ratio(spark, sf_dir):
    f, live = files(spark, sf_dir), _live(spark, sf_dir)
    return rounded(drift.drift_ratio(drift.diff(f, live), f, live), "ratio")


@query(O.with_(O.FILES.replace("files AS", "old AS"), _LIVE.replace("FROM files)", "FROM old)").replace("size + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime", "text"), "files AS (SELECT path, text FROM live)", *O.BASE[1:], O.queries(ASKED), O.QTERMS, O.scored(), O.ranked("scored", "top", 20), select=_HIT + "top"))
def overlay_rank(spark, sf_dir):
    indexed, live = files(spark, sf_dir), _live(spark, sf_dir)
    changes = drift.diff(indexed, live)
    fresh = lexical.chunk_tokens(chunking.window_chunks(drift.delta_files(live, changes)))
    return _hit(lexical.bm25(drift.overlay(tokens(spark, sf_dir), fresh, changes), asked(spark), 20))


@query("WITH e AS (SELECT 'dir' || s_suppkey AS dir, (s_suppkey * 7919 % 1000)::BIGINT AS bytes, (s_suppkey * 31 % 97)::BIGINT AS age, s_suppkey % 9 = 0 AS dead, s_suppkey = 5 AS protected FROM supplier), h AS (SELECT *, sum(bytes) OVER (ORDER BY protected DESC, age, dir ROWS UNBOUNDED PRECEDING) AS held FROM e WHERE NOT dead) SELECT dir, 'dead' AS why FROM e WHERE dead UNION ALL SELECT dir, 'over budget' FROM h WHERE held > 3000 AND NOT protected")
def lru_evict(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    entries = s.select(F.concat(F.lit("dir"), k.cast("string")).alias("dir"), (k * 7919 % 1000).cast("long").alias("bytes"), (k * 31 % 97).cast("long").alias("age"), (k % 9 == 0).alias("dead"), (k == 5).alias("protected"))
    return drift.evicted(entries, 3000)


@query(O.with_(O.FILES, "e AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS root FROM files UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)', 1) FROM files WHERE path LIKE 'e%')", select="SELECT path AS scope, arg_max('idx/' || root, length(root)) AS dir FROM files JOIN e ON starts_with(path, root || '/') GROUP BY path"))
def index_discovery(spark, sf_dir):
    f = files(spark, sf_dir)
    roots = f.select(F.substring_index("path", "/", 1).alias("root")).union(f.where("path LIKE 'e%'").select(F.substring_index("path", "/", 2))).distinct()
    entries = roots.select("root", F.concat(F.lit("idx/"), "root").alias("dir"), F.lit("w32o8").alias("entry_params"))
    return drift.covering(entries, f.select(F.col("path").alias("scope"), F.lit("w32o8").alias("params")))


# Evaluation: each benchmark item asks with its whole text; gold is the document that holds most of its tokens

_GOLD = (O.FILES, "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)", f"ft AS (SELECT path, unnest(list_distinct({O.tokens('text')})) AS term FROM files)", f"qt AS (SELECT query_id, unnest(list_distinct({O.tokens('query')})) AS term FROM q)", "held AS (SELECT query_id, path, count(*) AS n FROM ft JOIN qt USING (term) GROUP BY ALL)", "g AS (SELECT query_id, query, path AS gold_path FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS i FROM held) JOIN q USING (query_id) WHERE i = 1)")


def _gold(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asks = q.select("query_id", F.explode(F.array_distinct(T.text_tokens(F.col("query")))).alias("term"))
    few = asks.limit(lexical.FEW + 1).collect()
    every = frames.held(files(spark, sf_dir), "tokens", F.array_distinct(T.text_tokens(F.col("text"))))
    if len(few) <= lexical.FEW:  # each partition finds its best file of each query: no pair of a file and a query is shuffled
        rows = every.select("path", F.lit(1).alias("start_line"), F.lit(1).alias("dl"), "tokens")
        counted = passes.best(rows, [(r.query_id, r.term, 1.0) for r in few], 1).withColumnRenamed("score", "n")
    else:
        held = every.select("path", F.explode("tokens").alias("term"))
        counted = held.join(asks, "term").groupBy("query_id", "path").agg(F.count("*").alias("n"))
    best = counted.groupBy("query_id").agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("gold_path"))
    best = settled(best)
    return best.join(q, "query_id").select("query_id", "query", "gold_path")


@query(O.with_(*O.BASE, "queries AS (SELECT item_id AS query_id, text AS phrase FROM benchmark)", *_GOLD[1:], O.QTERMS, O.scored(), O.ranked("scored", "top", 10), "firsts AS (SELECT query_id, min(CASE WHEN path = gold_path THEN rank END) AS f FROM g LEFT JOIN top USING (query_id) GROUP BY query_id)", select="SELECT count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN f <= 10 THEN 1.0 / f ELSE 0 END), 6) AS mrr_10 FROM firsts"))
def recall_mrr(spark, sf_dir):
    gold = _gold(spark, sf_dir).select("query_id", "gold_path", F.lit(1).alias("gold_start"), F.lit(1 << 30).alias("gold_end"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    top = lexical.bm25(tokens(spark, sf_dir), q, 10).withColumn("end_line", F.col("start_line") + 31)
    return rounded(evaluation.metrics(evaluation.first_correct(top, gold)), "recall_1", "recall_5", "recall_10", "mrr_10")


@query("WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 8 END AS fa, CASE WHEN doc_id % 4 = 0 THEN 1 + doc_id % 9 END AS fb FROM labels) SELECT count(*) FILTER (WHERE coalesce(fa <= 5, false) AND NOT coalesce(fb <= 5, false)) AS only_a, count(*) FILTER (WHERE NOT coalesce(fa <= 5, false) AND coalesce(fb <= 5, false)) AS only_b, count(*) AS n FROM f")
def sign_test_counts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    a = d.withColumn("first", F.when(F.col("query_id") % 3 == 0, 1 + F.col("query_id") % 8))
    return evaluation.discordant(a, d.withColumn("first", F.when(F.col("query_id") % 4 == 0, 1 + F.col("query_id") % 9)))


_STOP = "'" + "', '".join("a an and are as at be by code does file find for from how in is it its of on or that the this to what when where which who why with".split()) + "'"
_CONTENT = "list_filter(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda t: lower(t) NOT IN (" + _STOP + "))"
_IDENT = "(contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]'))"
_LEAK = (f"l AS (SELECT query_id, query, lower(query) AS ql, {_CONTENT.format('query')} AS words, {_CONTENT.format('files.text')} AS held, lower(files.text) AS gl, gold_path, string_split(gold_path, '/') AS parts FROM g JOIN files ON files.path = gold_path)", "l2 AS (SELECT *, list_filter(list_transform(parts[1 : len(parts) - 1], lambda s: lower(s)), lambda s: length(s) >= 4 AND contains(ql, s)) AS segs, lower(regexp_replace(parts[len(parts)], '[.][^.]*$', '')) AS stem, list_distinct(list_transform(words, lambda w: lower(w))) AS mine, list_distinct(list_transform(held, lambda w: lower(w))) AS theirs, list_transform(list_filter(held, lambda w: " + _IDENT + "), lambda w: lower(w)) AS names FROM l)", "leak AS (SELECT query_id, len(list_filter(words, lambda w: " + _IDENT + ")) > 0 AS has_identifier, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))::INT AS n_words, contains(ql, lower(parts[len(parts)])) AS basename_in_query, length(stem) >= 4 AND contains(ql, stem) AS stem_in_query, len(segs) > 0 AS path_seg_in_query, len(list_filter(segs, lambda s: NOT contains(gl, s))) > 0 AS path_seg_not_in_gold, CASE WHEN len(mine) > 0 THEN len(list_intersect(mine, theirs)) / len(mine) ELSE 0 END AS gold_token_overlap, len(list_filter(words, lambda w: list_contains(names, lower(w))))::INT AS gold_id_hits FROM l2)")


def _leaks(spark, sf_dir):
    f = files(spark, sf_dir).select(F.col("path").alias("gold_path"), F.col("text").alias("gold_text"))
    return evaluation.leakage(_gold(spark, sf_dir).join(f, "gold_path"))


@query(O.with_(*_GOLD, *_LEAK, select="SELECT * REPLACE (round(gold_token_overlap, 6) AS gold_token_overlap), gold_id_hits = 0 AND gold_token_overlap <= 0.5 AS is_blind FROM leak"))
def leakage_profile(spark, sf_dir):
    return rounded(evaluation.blind(_leaks(spark, sf_dir)), "gold_token_overlap")


@query(O.with_(*_GOLD, *_LEAK, select="SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS n, round(avg(has_identifier::INT), 6) AS share_has_identifier, round(avg(stem_in_query::INT), 6) AS share_stem_in_query, quantile_cont(n_words, 0.5)::DOUBLE AS median_words, round(avg(gold_token_overlap), 6) AS mean_overlap FROM leak GROUP BY ALL"))
def leakage_summary(spark, sf_dir):
    kind = F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")
    return rounded(evaluation.leakage_summary(_leaks(spark, sf_dir).withColumn("kind", kind)), "share_has_identifier", "share_stem_in_query", "mean_overlap")


@query(O.with_(*_GOLD, *_LEAK, select="SELECT query_id FROM leak WHERE NOT (gold_id_hits = 0 AND gold_token_overlap <= 0.5)"))
def blind_gate(spark, sf_dir):
    f = files(spark, sf_dir).select(F.col("path").alias("gold_path"), F.col("text").alias("gold_text"))
    return evaluation.forbidden(_gold(spark, sf_dir).join(f, "gold_path"))


@query(O.with_(*_EXACT, "m AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines WHERE regexp_matches(line, '(?i)licensed.*version'))", "o AS (SELECT path, line_no, row_number() OVER (ORDER BY string_split(path, '/'), line_no)::INT AS rank FROM m WHERE n <= 3)", select="SELECT 1::BIGINT AS query_id, rank, path, line_no AS start_line, line_no AS end_line FROM o WHERE rank <= 10"))
def grep_baseline(spark, sf_dir):
    return evaluation.grep_baseline(files(spark, sf_dir), 1, "licensed the version")


@query(O.with_(*_GOLD, O.LS, O.LINES, f"qw AS (SELECT query_id, gold_path, list_transform({_CONTENT.format('query')}, lambda w: lower(w)) AS l FROM g)", "firsts AS (SELECT query_id, gold_path, unnest(list_filter(l, lambda w, i: list_position(l, w) = i)[1:12]) AS word FROM qw)", "lw AS (SELECT path, line_no, unnest(list_distinct(list_transform(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda w: lower(w)))) AS word FROM lines)", "hit AS (SELECT query_id, gold_path, word, path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id, word, path ORDER BY line_no) AS n FROM lw JOIN firsts USING (word)) WHERE n <= 3)", "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, word ORDER BY string_split(path, '/'), line_no) AS rank FROM hit)", "best AS (SELECT query_id, min(rank)::INT AS best FROM rk WHERE path = gold_path GROUP BY query_id)", select="SELECT query_id, best FROM g LEFT JOIN best USING (query_id)"))
def oracle_grep(spark, sf_dir):
    gold = _gold(spark, sf_dir).select("query_id", "query", "gold_path", F.lit(1).alias("gold_start"), F.lit(1 << 30).alias("gold_end"))
    return evaluation.oracle_grep(files(spark, sf_dir), gold)


@query(O.with_(*_GOLD, O.LS, "v AS (SELECT query_id, query, gold_path, 1 AS a, (query_id % 40)::INT AS b, 'x' AS sha, ls FROM g LEFT JOIN ls ON ls.path = gold_path)", "t AS (SELECT *, count(*) OVER (PARTITION BY query) AS times, array_to_string(ls[a : b], chr(10)) AS body FROM v)", "p AS (SELECT query_id, unnest([CASE WHEN trim(query) = '' THEN 'empty query' END, CASE WHEN times > 1 THEN 'repeated query' END, CASE WHEN ls IS NULL THEN 'gold file is gone' END, CASE WHEN a > b THEN 'span out of order' END, CASE WHEN a < 1 THEN 'span before the file' END, CASE WHEN b > len(ls) THEN 'span beyond the file' END, CASE WHEN ls IS NOT NULL AND trim(coalesce(body, '')) = '' THEN 'gold is blank' END, CASE WHEN ls IS NOT NULL AND sha <> left(sha256(coalesce(body, '')), 16) THEN 'gold has changed' END]) AS problem FROM t)", select="SELECT query_id, problem FROM p WHERE problem IS NOT NULL"))
def query_validation(spark, sf_dir):
    gold = _gold(spark, sf_dir).select("query_id", "query", "gold_path", F.lit(1).alias("gold_start"), (F.col("query_id") % 40).cast("int").alias("gold_end"), F.lit("x").alias("gold_sha"))
    return evaluation.query_problems(gold, files(spark, sf_dir))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def stage_percentiles(spark, sf_dir):
    return rounded(evaluation.percentiles(table(spark, sf_dir, "events"), "value", "event_type"), "p50", "p90", "p99")


@query("WITH o AS (SELECT role AS kind, conv_id * 1000 + turn AS i, sha256(coalesce(text, '')) AS d FROM conversations), r AS (SELECT kind, i // 4096 AS run, count(*) AS n, sha256(string_agg(d, '' ORDER BY i, d)) AS d FROM o GROUP BY ALL) SELECT kind, sum(n)::BIGINT AS n, left(sha256(string_agg(d, '' ORDER BY run)), 16) AS fingerprint FROM r GROUP BY kind")
def query_manifest(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return evaluation.manifest(q)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_hybrid(spark, sf_dir)


from quarry.plans import checks  # noqa: E402, F401  registers its queries too
