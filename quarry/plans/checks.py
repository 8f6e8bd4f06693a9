"""More named queries with their SQL: whole searches, the stages of their tail, indexes, reports, text functions."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import frames
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import chunking, display, evaluation, exact, finalize, lexical, reports, semantic
from quarry.operators.finalize import Finalize
from quarry.operators.lexical import KEY
from quarry.plans import index
from quarry.plans import oracles as O
from quarry.plans.registry import _BM25, _EXACT, _FUSED, _HIT, _SIF, _TWO, _hit, asked, chunks, files, query, rounded, table, tokens
from quarry.plans.search import SearchOptions, report, resolve_mode, search
from quarry.sources import corpus

# Whole searches with a plain tail: no fine windows, no diversity, no learned relevance

#: A tail that keeps the order of the pool.
PLAIN = Finalize(fine=False, diversify=False, learned_blend=0.0, dedupe_overlap=1.01)
_PHRASES = "there is a thing|licensed under the|token"
_BEST = f"ln AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT h.*, c.end_line, string_split(c.body, chr(10)) AS ls, (SELECT list_distinct({O.tokens('phrase')}) FROM first_phrase f WHERE f.query_id = h.query_id) AS want FROM hit h JOIN chunks c USING (path, start_line)))", f"pick AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY len(list_intersect(want, {O.tokens('ls[i]')})) DESC, CASE WHEN regexp_matches(ls[i], '[\\p{{L}}\\p{{N}}]') THEN 0 ELSE 1 END, i) AS r FROM ln)"
_FOUND = "SELECT query_id, rank, path, start_line, end_line, (start_line + i - 1)::INT AS line, ls[i] AS text, round(score, 6) AS score FROM pick WHERE r = 1"
_SCALE = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END"


def _plain(spark, sf_dir, mode, raw=None, **more):
    raw = asked(spark, "raw") if raw is None else raw
    found = search(files(spark, sf_dir), raw, SearchOptions(mode=mode, decl_boost=0.0, tail=PLAIN, **more))
    return rounded(found.select("query_id", "rank", "path", "start_line", "end_line", "line", "text", "score"), "score")


@query(O.with_(*_BM25, "first_phrase AS (SELECT * FROM queries)", O.scored(), O.ranked("scored", "lex", 128), f"hit AS (SELECT query_id, rank, path, start_line, {_SCALE} AS score FROM lex WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id) QUALIFY rank <= 5)", *_BEST, select=_FOUND))
def search_plain_bm25(spark, sf_dir):
    return _plain(spark, sf_dir, "bm25")


@query(O.with_(*_BM25, "first_phrase AS (SELECT * FROM queries)", O.scored(scope="path LIKE 'de/%'"), O.ranked("scored", "lex", 128), f"hit AS (SELECT query_id, rank, path, start_line, {_SCALE} AS score FROM lex WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id) QUALIFY rank <= 5)", *_BEST, select=_FOUND))
def search_plain_scoped(spark, sf_dir):
    return _plain(spark, sf_dir, "bm25", prefix="de")


@query(O.with_(*_TWO, "first_phrase AS (SELECT * FROM queries)", _FUSED, O.ranked("fused", "out", 256), f"hit AS (SELECT query_id, rank, path, start_line, {_SCALE} AS score FROM out WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id) QUALIFY rank <= 5)", *_BEST, select=_FOUND))
def search_plain_hybrid(spark, sf_dir):
    return _plain(spark, sf_dir, "hybrid", bm25_pin=0)


@query(O.with_(*_TWO, "first_phrase AS (SELECT * FROM queries)", f"hit AS (SELECT query_id, rank, path, start_line, {_SCALE.replace('score', '(1 - distance)')} AS score FROM sem WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id) QUALIFY rank <= 5)", *_BEST, select=_FOUND))
def search_plain_semantic(spark, sf_dir):
    return _plain(spark, sf_dir, "semantic", bm25_pin=0)


_MULTI = (*O.BASE, O.queries(list(enumerate(_PHRASES.split("|")))), "first_phrase AS (SELECT 1::BIGINT AS query_id, phrase FROM queries WHERE query_id = 0)", O.QTERMS, O.scored(), O.ranked("scored", "lex", 128), f"flat AS (SELECT query_id AS p, rank, path, start_line, {_SCALE} AS score, row_number() OVER (ORDER BY rank, query_id) AS turn FROM lex WHERE rank <= 60 WINDOW w AS (PARTITION BY query_id))", "merged AS (SELECT path, start_line, min(turn) AS turn, arg_min(score, turn) AS score FROM flat GROUP BY ALL)", "hit AS (SELECT * FROM (SELECT 1::BIGINT AS query_id, row_number() OVER (ORDER BY turn)::INT AS rank, path, start_line, score FROM merged) WHERE rank <= 10)")


@query(O.with_(*_MULTI, *_BEST, select=_FOUND))
def search_plain_phrases(spark, sf_dir):
    return _plain(spark, sf_dir, "bm25", spark.createDataFrame([(1, _PHRASES)], "query_id long, raw string"), k=10, bm25_pin=0)


@query(O.with_(*_MULTI, select="SELECT count(*) AS hits, count(DISTINCT path) AS files, round(max(score), 6) AS best_score, [1, 2] AS missed_phrases FROM hit"))
def search_plain_report(spark, sf_dir):
    raw = spark.createDataFrame([(1, _PHRASES)], "query_id long, raw string")
    found = search(files(spark, sf_dir), raw, SearchOptions(mode="bm25", decl_boost=0.0, tail=PLAIN, k=10, bm25_pin=0))
    return rounded(report(found, _PHRASES), "best_score")


@query(O.with_(*_BM25, O.scored(), O.ranked("scored", "top", 128), select=_HIT + "top"))
def warm_bm25(spark, sf_dir):
    """The ranking of an index that was written, published and loaded: from its postings and stats."""
    path, options = f"{_shared(spark)}/index-{uuid.uuid4().hex}", SearchOptions(mode="bm25")
    index.build(files(spark, sf_dir), options, path)
    return _hit(lexical.bm25(index.load(spark, path, options).terms, asked(spark)))


@query(O.with_(*O.BASE[:6], select="SELECT count(*) AS rows, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS total, 0::BIGINT AS out_of_order FROM terms"))
def postings_order(spark, sf_dir):
    """Postings of an index lie by term, path and line in every file."""
    path, options = f"{_shared(spark)}/index-{uuid.uuid4().hex}", SearchOptions(mode="bm25")
    index.build(files(spark, sf_dir), options, path)
    rows = index.load(spark, path, options).terms.postings
    bad = index.out_of_order(rows).agg(F.sum("bad").alias("out_of_order"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("term").alias("terms"), F.sum(F.col("tf").cast("long")).alias("total")).crossJoin(bad)


@query("SELECT 2::BIGINT AS indexes, 1::BIGINT AS dead, 1::BIGINT AS evicted, 1::BIGINT AS cleared")
def index_upkeep(spark, sf_dir):
    """Two indexes, one of whose corpus is gone: eviction takes that, clearing the other, and nothing else is listed."""
    folder, options = f"{_shared(spark)}/cache-{uuid.uuid4().hex}", SearchOptions(mode="bm25")
    few = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), "text")
    index.build(few, options, f"{folder}/a", sf_dir)
    index.build(few, options, f"{folder}/b", f"{folder}/gone")
    few.select("path").write.parquet(f"{folder}/other")
    listed = index.registry(spark, folder).agg(F.count("*").alias("indexes"), F.count_if("dead").alias("dead"))
    return spark.createDataFrame(listed.toPandas()).withColumn("evicted", F.lit(len(index.enforce_budget(spark, folder))).cast("long")).withColumn("cleared", F.lit(len(index.clear(spark, folder))).cast("long"))


def _shared(spark) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="quarry-")


# Sources


@query("WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.quarry/' WHEN 1 THEN 'a/.hidden/' ELSE lang || '/' END || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size FROM documents) SELECT path, size FROM f WHERE doc_id % 5 > 1 AND doc_id % 7 <> 0 AND size <= 8192")
def text_sniff(spark, sf_dir):
    """What a walk keeps: no index folder, nothing hidden, no file with a zero byte, none too large."""
    d = F.col("doc_id")
    folder = F.when(d % 5 == 0, ".quarry/").when(d % 5 == 1, "a/.hidden/").otherwise(F.concat("lang", F.lit("/")))
    content = F.when(d % 7 == 0, F.concat(F.lit(b"x\0"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    rows = table(spark, sf_dir, "documents").select(F.concat(folder, d.cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), content.alias("content"))
    return corpus.readable(rows, 8192).select("path", "size")


@query(O.with_(O.FILES, select=r"SELECT path FROM files WHERE CASE WHEN regexp_matches(path, '^es/src2/') THEN false WHEN regexp_matches(path, '^en/([^/]+/)*src1(/|$)') AND NOT regexp_matches(path, '^en/.*7[.]txt$') THEN false ELSE NOT regexp_matches(path, '(^|/)[^/]*3[.]txt$') OR regexp_matches(path, '^de/(.*/)?13[.]txt$') END"))
def walk_ignored(spark, sf_dir):
    rules = {".gitignore": "# numbers\n*3.txt\n/es/src2\n", "en/.gitignore": "src1\n!*7.txt\n*3.txt\n", "de/.ignore": "!13.txt"}
    return corpus.unignored(files(spark, sf_dir), rules).select("path")


@query(O.with_(*_EXACT, select="SELECT least(count(*), 40) AS n FROM lines WHERE contains(line, 'tion')"))
def exact_max_hits(spark, sf_dir):
    return exact.search(files(spark, sf_dir), "tion", literal=True).limit(40).agg(F.count("*").alias("n"))


@query(O.with_(*_EXACT, select="SELECT path || ':' || line_no || ':' || CASE WHEN length(ltrim(line)) > 200 THEN left(ltrim(line), 200) || ' [… +' || (length(ltrim(line)) - 200) || ' chars]' ELSE ltrim(line) END AS value FROM lines WHERE contains(line, 'token')"))
def hit_records(spark, sf_dir):
    found = exact.search(files(spark, sf_dir), "token", literal=True)
    return found.select(display.record(F.col("path"), F.col("line_no"), F.col("line")).alias("value"))


@query(O.with_(*_EXACT, select="SELECT json_object('path', path, 'line', line_no, 'score', 1.5)::VARCHAR AS value FROM lines WHERE contains(line, 'token')"))
def hit_objects(spark, sf_dir):
    found = exact.search(files(spark, sf_dir), "token", literal=True)
    return display.json_lines(found.select("path", F.col("line_no").alias("line"), F.lit(1.5).alias("score"), F.lit(None).cast("string").alias("gone")))


# Chunks

_NARROW = O.CHUNKS.replace("a + 32", "a + 12").replace("24)", "9)").replace("a + 8 <", "a + 3 <")


@query(O.with_(O.FILES, O.LS, _NARROW, select="SELECT path, start_line, end_line FROM chunks"))
def chunk_rewindow(spark, sf_dir):
    return chunking.window_chunks(files(spark, sf_dir), chunking.ChunkParams().with_window(12)).select("path", "start_line", "end_line")


@query("WITH RECURSIVE " + ",\n".join([
    O.FILES, O.LS,
    r"sz AS (SELECT path, len(ls) AS n, list_transform(ls, lambda x: length(regexp_replace(x, '\s', '', 'g'))) AS s FROM ls WHERE len(ls) > 0)",
    "cut(path, a, b, n, s) AS (SELECT path, 0, (SELECT coalesce(min(e), n) FROM unnest(range(1, n + 1)) t(e) WHERE list_sum(s[1 : e]) >= 800), n, s FROM sz UNION ALL SELECT path, c, coalesce((SELECT min(e) FROM unnest(range(c + 1, n + 1)) t(e) WHERE list_sum(s[c + 1 : e]) >= 800), n), n, s FROM (SELECT path, n, s, greatest(coalesce((SELECT min(k) FROM unnest(range(a + 1, b)) t(k) WHERE list_sum(s[k + 1 : b]) <= 200 AND (k + 1 = b OR list_sum(s[k + 2 : b]) < 200)), b), a + 1) AS c FROM cut WHERE b < n))",
]) + r" SELECT path, (a + 1)::INT AS start_line, b::INT AS end_line FROM cut JOIN ls USING (path) WHERE regexp_matches(array_to_string(ls[a + 1 : b], chr(10)), '\S')")
def chunk_budget(spark, sf_dir):
    return chunking.budget_chunks(files(spark, sf_dir), chunking.ChunkParams(budget=800)).select("path", "start_line", "end_line")


# The tail of a search, stage by stage


@query(O.with_(*_BM25, O.scored(), O.ranked("scored", "top", 60), "RECURSIVE_HERE", select="SELECT query_id, t.i::INT AS place, split_part(t.k, '#', 1) AS path, split_part(t.k, '#', 2)::INT AS start_line FROM (SELECT query_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS i FROM go WHERE r = 60) t").replace("WITH files", "WITH RECURSIVE files").replace("RECURSIVE_HERE", "go(query_id, r, kept) AS (SELECT DISTINCT query_id, 0, []::VARCHAR[] FROM top UNION ALL SELECT go.query_id, go.r + 1, CASE WHEN t.path IS NULL OR len(list_filter(kept, lambda k: split_part(k, '#', 1) = t.path AND abs(split_part(k, '#', 2)::INT - t.start_line) < 32)) > 0 THEN kept ELSE list_append(kept, t.path || '#' || t.start_line) END FROM go LEFT JOIN top t ON t.query_id = go.query_id AND t.rank = go.r + 1 WHERE go.r < 60)"))
def span_dedupe(spark, sf_dir):
    """Windows of 32 lines every 24: two of a file overlap if their first lines lie under 32 apart, short tails too."""
    top = lexical.bm25(tokens(spark, sf_dir), asked(spark), 60).select("query_id", "rank", *KEY)

    def run(pdf):
        rows = [finalize.Row(r.path, int(r.start_line), int(r.start_line) + 31, [], 0.0) for r in pdf.sort_values("rank").itertuples(index=False)]
        kept = finalize.dedupe(rows, 0.0)
        return pd.DataFrame({"query_id": [int(pdf.query_id.iloc[0])] * len(kept), "place": range(1, len(kept) + 1), "path": [r.path for r in kept], "start_line": [r.start for r in kept]})

    return top.groupBy("query_id").applyInPandas(run, "query_id long, place int, path string, start_line int")


_MMR_ROWS = "e AS (SELECT label AS g, vec_id AS i, embedding::DOUBLE[] AS v, (vec_id * 37 % 101) / 100.0::DOUBLE AS rel FROM embeddings), s AS (SELECT g, i, v, (rel - min(rel) OVER w) / (max(rel) OVER w - min(rel) OVER w) AS rel FROM e WINDOW w AS (PARTITION BY g))"


@query("WITH RECURSIVE " + _MMR_ROWS + ", go(g, step, chosen) AS (SELECT DISTINCT g, 0, []::BIGINT[] FROM s UNION ALL SELECT g, step + 1, list_append(chosen, (SELECT arg_max(i, (x, -i)) FROM (SELECT s.i, round(0.75 * s.rel - 0.25 * greatest(0, coalesce((SELECT max(list_cosine_similarity(s.v, o.v)) FROM s o WHERE o.g = s.g AND list_contains(chosen, o.i)), 0)), 12) AS x FROM s WHERE s.g = go.g AND NOT list_contains(chosen, s.i)))) FROM go WHERE step < 6) SELECT g AS label, t.k::INT AS place, t.i AS vec_id FROM (SELECT g, unnest(chosen) AS i, generate_subscripts(chosen, 1) AS k FROM go WHERE step = 6) t")
def mmr_select(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")

    def run(pdf):
        pdf = pdf.sort_values("vec_id")
        picked = finalize.mmr([(i * 37 % 101) / 100.0 for i in pdf.vec_id], [np.asarray(v, float) for v in pdf.embedding], 6, 0.75)
        return pd.DataFrame({"label": pdf.label.iloc[picked].tolist(), "place": range(1, len(picked) + 1), "vec_id": pdf.vec_id.iloc[picked].tolist()})

    return rows.groupBy("label").applyInPandas(run, f"label {dict(rows.dtypes)['label']}, place int, vec_id long")


_WINDOW_SUM = ", ".join(f"sum(h{d}) AS v{d}" for d in range(32))
_WINDOW_Q = "[" + ", ".join(f"round(greatest(-127, least(127, v{d} / {O._NORM} * 127))) / 127" for d in range(32)) + "]"


@query(O.with_(
    *_BM25, O.scored(), O.ranked("scored", "head", 6), O.TV, O.pooled("qv", "query_id", "qterms JOIN tv USING (term)", "weight"), f"qq AS (SELECT query_id, {_WINDOW_Q} AS q FROM qv)",
    "hl AS (SELECT query_id, path, start_line, string_split(body, chr(10)) AS ls FROM head JOIN chunks USING (path, start_line))",
    "win AS (SELECT query_id, path, start_line, a, least(6, len(ls)) AS h, ls FROM (SELECT *, unnest(range(0, len(ls) - least(6, len(ls)) + 1)) AS a FROM hl))",
    f"wt AS (SELECT query_id, path, start_line, a, unnest({O.tokens('array_to_string(ls[a + 1 : a + h], chr(10))')}) AS term FROM win)",
    f"wv AS (SELECT query_id, path, start_line, a, {_WINDOW_SUM} FROM wt JOIN tv USING (term) GROUP BY ALL)",
    f"wc AS (SELECT wv.query_id, path, start_line, a, list_dot_product(q, {_WINDOW_Q}) AS cosine FROM wv JOIN qq USING (query_id))",
    select="SELECT query_id, path, start_line, round(max(cosine), 6) AS best FROM wc GROUP BY ALL",
))
def fine_windows(spark, sf_dir):
    """The cosine of the best window of six lines in each of the first chunks."""
    top = lexical.bm25(tokens(spark, sf_dir), asked(spark), 6).select("query_id", *KEY)
    rows = top.join(chunks(spark, sf_dir), KEY).join(asked(spark), "query_id")

    def run(stream):
        for pdf in stream:
            out = []
            for r in pdf.itertuples(index=False):
                row = finalize.Row(r.path, int(r.start_line), int(r.end_line), r.body.split("\n"), 0.0)
                best = finalize.fine_window(row, [finalize.embed(r.phrase, 32)], 6, 32)
                out.append((int(r.query_id), r.path, int(r.start_line), round(best[2], 6)))
            yield pd.DataFrame(out, columns=["query_id", "path", "start_line", "best"])

    return rows.mapInPandas(run, "query_id long, path string, start_line int, best double")


@query("SELECT g, v, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END, 6) AS zero, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS half, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 1.0 END, 6) AS one FROM (SELECT g, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM (SELECT doc_id % 50 AS g, (doc_id * 13 % (1 + doc_id % 50))::DOUBLE AS v FROM documents) WINDOW w AS (PARTITION BY g))")
def min_max_variants(spark, sf_dir):
    from pyspark.sql import Window

    d, w = F.col("doc_id"), Window.partitionBy("g")
    rows = table(spark, sf_dir, "documents").select((d % 50).alias("g"), (d * 13 % (1 + d % 50)).cast("double").alias("v"))
    scaled = lambda flat: F.round(V.min_max(F.col("v"), F.min("v").over(w), F.max("v").over(w), flat), 6)
    return rows.select("g", "v", scaled(0.0).alias("zero"), scaled(0.5).alias("half"), scaled(1.0).alias("one"))


@query(O.with_("u AS (SELECT vec_id, " + O.UNIT.format(v="embedding") + " AS v FROM embeddings)", select="SELECT vec_id, list_transform(v, lambda x: round(round(x * 127) / 127, 9) + 0.0::DOUBLE) AS stored FROM u"))
def vector_as_stored(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.transform(V.as_stored(F.col("embedding")), lambda x: F.round(x, 9)).alias("stored"))


# Weights


@query(O.with_(*O.BASE[:4], *_SIF, "n AS (SELECT count(DISTINCT path) AS n FROM tok)", select="SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS w FROM sif, n"))
def sif_idf_weights(spark, sf_dir):
    return rounded(semantic.weights_of(tokens(spark, sf_dir), by_idf=True).table, "w")


@query(O.with_(*O.BASE[:4], *_SIF, select="SELECT qt AS term, round(coalesce(w, 1.0), 6) AS w FROM (VALUES ('the'), ('zzunseen'), ('token')) v(qt) LEFT JOIN w ON w.term = qt"))
def sif_unseen(spark, sf_dir):
    weights = semantic.weights_of(tokens(spark, sf_dir))
    asks = spark.createDataFrame([("the",), ("zzunseen",), ("token",)], "term string")
    return asks.join(weights.table, "term", "left").select("term", F.round(F.coalesce("w", F.lit(weights.unseen)), 6).alias("w"))


# Text functions


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS r, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS g FROM documents), u AS (SELECT doc_id, i, strlen(g[i]) AS gap, strlen(r[i]) AS run FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM t)), s AS (SELECT doc_id, i, run, sum(gap + run) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM u) SELECT doc_id, coalesce(string_agg((e - run) || '-' || e, ' ' ORDER BY i), '') AS ranges FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id")
def word_ranges(spark, sf_dir):
    ranges = F.transform(T.word_ranges(F.col("text")), lambda r: F.concat_ws("-", r["start"], r["end"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ranges, " ").alias("ranges"))


_ALL = O.tokens("path", False)


@query(O.with_(O.FILES, select=f"SELECT path, array_to_string({_ALL}, ' ') AS full_, array_to_string(list_filter({_ALL}, lambda t, i: list_position({_ALL}, t) = i), ' ') AS once, array_to_string(CASE WHEN len({_ALL}) > 2 THEN ({_ALL})[len({_ALL}) - 1 : len({_ALL})] ELSE {_ALL} END, ' ') AS scaled FROM files"))
def path_renders(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", F.concat_ws(" ", T.render_path(p)).alias("full_"), F.concat_ws(" ", T.render_path(p, "dedupe")).alias("once"), F.concat_ws(" ", T.render_path(p, "scaled", F.lit(8))).alias("scaled"))


def _list(words: str) -> str:
    return "('" + "', '".join(words.split()) + "')"


_KW_SQL = _list("if else for while do switch case break continue return goto try catch finally throw new delete this super class struct enum union interface trait impl def fn func function let var const static public private protected void int long float double bool char string true false null none nil self import from use package module namespace extends implements")
_MORE_SQL = _list("async await yield lambda with as in is not and or pass raise except elif unless until begin end then loop match where mut pub crate mod type typedef sizeof volatile extern inline register signed unsigned short virtual override final abstract template typename operator friend using")
_LOW_SQL = _list("get set data value values item items obj object tmp temp foo bar result res ret arg args param params key keys val idx index i j k n x y s str buf ptr list map node info ctx context name names id ids util utils helper helpers misc")
_NUMBER = "regexp_matches(t, '^[0-9]+$')"
_PARTS = O.tokens("text", False)
_NO_KW = f"list_filter({_PARTS}, lambda t: t NOT IN {_KW_SQL} AND NOT {_NUMBER})"
_LEX = f"list_filter({_PARTS}, lambda t: t NOT IN {_KW_SQL} AND t NOT IN {_MORE_SQL} AND NOT {_NUMBER} AND t NOT IN {_LOW_SQL})"
_ONCE = f"list_filter({_LEX}, lambda t, i: list_position({_LEX}, t) = i)"


@query(f"WITH l AS (SELECT doc_id, {_LEX} AS l FROM documents), u AS (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l) GROUP BY ALL), o AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS once FROM u GROUP BY doc_id) SELECT doc_id, md5(array_to_string({O.tokens('text')}, ' ')) AS split_whole, md5(array_to_string({_NO_KW}, ' ')) AS no_keywords, md5(array_to_string(l, ' ')) AS lexical, md5(coalesce(once, '')) AS once, text AS none FROM documents JOIN l USING (doc_id) LEFT JOIN o USING (doc_id)")
def prose_tiers(spark, sf_dir):
    docs = frames.held(corpus.spread(table(spark, sf_dir, "documents")), "parts", T.text_tokens(F.col("text"), False))
    body = lambda tier: F.md5(F.concat_ws(" ", T.render_body(F.col("text"), tier, parts=F.col("parts"))))
    return docs.select("doc_id", body("split-whole").alias("split_whole"), body("split-nokw").alias("no_keywords"), body("prune-lex").alias("lexical"), body("prune-uniq").alias("once"), F.get(T.render_body(F.col("text"), "none"), F.lit(0)).alias("none"))


@query(f"SELECT item_id, array_to_string({_PARTS}, ' ') AS kept, array_to_string({_LEX}, ' ') AS low, array_to_string({_ONCE}, ' ') AS once FROM benchmark")
def query_renders(spark, sf_dir):
    asks = lambda tier: F.concat_ws(" ", T.render_query(F.col("text"), tier))
    return table(spark, sf_dir, "benchmark").select("item_id", asks("prune-kw-pos-q0").alias("kept"), asks("prune-lex-sym").alias("low"), asks("prune-uniq-sym").alias("once"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN b < 1000 THEN b::BIGINT || ' B' WHEN b < 1000000 THEN ((b + 50) // 1000)::BIGINT || '.' || ((b + 50) // 100 % 10)::BIGINT || ' KB' WHEN b < 1000000000 THEN ((b + 50000) // 1000000)::BIGINT || '.' || ((b + 50000) // 100000 % 10)::BIGINT || ' MB' ELSE ((b + 50000000) // 1000000000)::BIGINT || '.' || ((b + 50000000) // 100000000 % 10)::BIGINT || ' GB' END AS size FROM (SELECT l_orderkey, l_linenumber, (l_partkey::BIGINT * l_suppkey * 7919 % 100003) * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 1009 ELSE 100003 END AS b FROM lineitem)")
def human_bytes(spark, sf_dir):
    scale = F.when(F.col("l_linenumber") % 3 == 0, 1).when(F.col("l_linenumber") % 3 == 1, 1009).otherwise(100003)
    size = (F.col("l_partkey").cast("long") * F.col("l_suppkey") * 7919 % 100003) * scale
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.human(size).alias("size"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\"a\\\"b/' || doc_id || '\"' WHEN 1 THEN '\"a:\\n' || doc_id || '\"' WHEN 2 THEN '\"t\\t' || doc_id || '\"' ELSE 'plain dir/' || doc_id END AS quoted FROM documents")
def quoted_paths(spark, sf_dir):
    d = F.col("doc_id")
    path = F.when(d % 4 == 0, 'a"b/').when(d % 4 == 1, "a:\n").when(d % 4 == 2, "t\t").otherwise("plain dir/")
    return table(spark, sf_dir, "documents").select("doc_id", T.quoted_path(F.concat(path, d.cast("string"))).alias("quoted"))


@query("SELECT * FROM (VALUES ('3-5', 3, 5), ('7-', 7, 2147483647), ('-4', 1, 4), ('9-2', -1, -1), ('x', -1, -1), ('-', -1, -1)) v(given, low, high)")
def parse_ranges(spark, sf_dir):
    def parsed(text):
        try:
            return T.parse_lines(text)
        except ValueError:
            return -1, -1

    return spark.createDataFrame([(t, *parsed(t)) for t in ("3-5", "7-", "-4", "9-2", "x", "-")], "given string, low int, high int")


@query("SELECT * FROM (VALUES ('1', 1), ('10000', 10000), ('0', -1), ('10001', -1), ('x', -1)) v(given, k)")
def parse_tops(spark, sf_dir):
    def parsed(text):
        try:
            return T.parse_top(text)
        except ValueError:
            return -1

    return spark.createDataFrame([(t, parsed(t)) for t in ("1", "10000", "0", "10001", "x")], "given string, k int")


@query("SELECT p AS pattern, m AS asked, CASE WHEN p THEN 'keyword' WHEN m IS NULL THEN 'semantic' ELSE m END AS mode FROM (VALUES (true), (false)) a(p), (VALUES (NULL), ('keyword'), ('bm25'), ('semantic'), ('hybrid')) b(m)")
def mode_resolution(spark, sf_dir):
    rows = [(p, m, resolve_mode(p, m)[0]) for p in (True, False) for m in (None, "keyword", "bm25", "semantic", "hybrid")]
    return spark.createDataFrame(rows, "pattern boolean, asked string, mode string")


@query("SELECT c_custkey AS i, greatest(a, c) <= least(b, d) AS touches, least(b, d) - greatest(a, c) + 1 >= 0.5 * least(b - a + 1, d - c + 1) AS half FROM (SELECT c_custkey, c_custkey % 40 AS a, c_custkey % 40 + c_custkey % 9 AS b, c_custkey * 7 % 40 AS c, c_custkey * 7 % 40 + c_custkey % 13 AS d FROM customer)")
def span_overlaps(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), (k % 40).alias("a"), (k % 40 + k % 9).alias("b"), (k * 7 % 40).alias("c"), (k * 7 % 40 + k % 13).alias("d"))

    def run(stream):
        for pdf in stream:
            both = [((a, b), (c, d)) for a, b, c, d in zip(pdf.a, pdf.b, pdf.c, pdf.d, strict=True)]
            yield pd.DataFrame({"i": pdf.i, "touches": [bool(finalize.overlapping(x, y, 0.0)) for x, y in both], "half": [bool(finalize.overlapping(x, y, 0.5)) for x, y in both]})

    return rows.mapInPandas(run, f"i {dict(rows.dtypes)['i']}, touches boolean, half boolean")


# Evaluation


@query("WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 8 END AS fa, CASE WHEN doc_id % 4 = 0 THEN 1 + doc_id % 9 END AS fb FROM labels), c AS (SELECT count(*) FILTER (WHERE NOT coalesce(fa <= 5, false) AND coalesce(fb <= 5, false)) AS wins, count(*) FILTER (WHERE coalesce(fa <= 5, false) AND NOT coalesce(fb <= 5, false)) AS losses, avg(coalesce(fb <= 5, false)::INT - coalesce(fa <= 5, false)::INT) AS delta FROM f) SELECT wins, losses, round(delta, 6) AS delta, round(least(1, CASE WHEN wins + losses = 0 THEN 1 ELSE 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM unnest(range(0, least(wins, losses) + 1)) t(i)) END), 6) AS p FROM c")
def paired_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    a = d.withColumn("first", F.when(F.col("query_id") % 3 == 0, 1 + F.col("query_id") % 8))
    out = evaluation.compare(a, d.withColumn("first", F.when(F.col("query_id") % 4 == 0, 1 + F.col("query_id") % 9)))
    return spark.createDataFrame([(out["wins"], out["losses"], round(out["delta"], 6), round(out["p"], 6))], "wins long, losses long, delta double, p double")


@query(O.with_(*_EXACT, "m AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines WHERE regexp_matches(line, '(?i)licensed.*version.*terms|licensed|version|terms'))", "o AS (SELECT path, line_no, row_number() OVER (ORDER BY string_split(path, '/'), line_no)::INT AS rank FROM m WHERE n <= 3)", select="SELECT 1::BIGINT AS query_id, rank, path, line_no AS start_line, line_no AS end_line FROM o WHERE rank <= 10"))
def grep_strong(spark, sf_dir):
    return evaluation.grep_baseline(files(spark, sf_dir), 1, "licensed the version terms", strong=True)


@query(O.with_(O.FILES, O.LS, "w AS (SELECT path, (a + 1)::INT AS start_line, least(a + 30, len(ls))::INT AS end_line, array_to_string(ls[a + 1 : a + 30], chr(10)) AS body FROM (SELECT path, ls, unnest(range(0, len(ls), 30)) AS a FROM ls WHERE len(ls) > 0))", select=r"SELECT path, start_line, end_line FROM w WHERE length(body) >= 200 AND regexp_matches(body, '\S') ORDER BY md5('0#' || path || '#' || start_line), path, start_line LIMIT 40"))
def sampled_windows(spark, sf_dir):
    return evaluation.sampled_windows(files(spark, sf_dir), 40).select("path", "start_line", "end_line")


_TRACES = "t AS (SELECT CASE WHEN doc_id % 19 = 0 THEN 'same' ELSE 'd' || doc_id END AS id, CASE doc_id % 4 WHEN 0 THEN 'where is flushQueue used' WHEN 1 THEN 'the Retry logic of net' WHEN 2 THEN ' ' ELSE 'something else' END AS query, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'odd' WHEN doc_id % 4 = 0 THEN 'golden' WHEN doc_id % 4 = 1 THEN 'guess' ELSE 'blind' END AS tier, CASE WHEN doc_id % 11 = 0 THEN 'made' ELSE 'generated' END AS source, CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] ELSE ['src/net/retry.rs:Queue.flushQueue'] END AS funcs, CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] ELSE ['src/net/retry.rs'] END AS fs FROM documents)"
_TIER = "CASE WHEN len(funcs) = 0 AND len(fs) = 0 THEN NULL WHEN regexp_matches(query, '(^|[^A-Za-z0-9_])(Queue|flushQueue)($|[^A-Za-z0-9_])') AND len(funcs) > 0 THEN 'golden' WHEN regexp_matches(lower(query), '(^|[^A-Za-z0-9_])(net|retry)($|[^A-Za-z0-9_])') THEN 'guess' ELSE 'blind' END"


def _traces(spark, sf_dir):
    d = F.col("doc_id")
    some = lambda x: F.when(d % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(x)))
    return table(spark, sf_dir, "documents").select(
        F.when(d % 19 == 0, "same").otherwise(F.concat(F.lit("d"), d.cast("string"))).alias("id"),
        F.when(d % 4 == 0, "where is flushQueue used").when(d % 4 == 1, "the Retry logic of net").when(d % 4 == 2, " ").otherwise("something else").alias("query"),
        F.when(d % 7 == 0, None).when(d % 5 == 0, "odd").when(d % 4 == 0, "golden").when(d % 4 == 1, "guess").otherwise("blind").alias("tier"),
        F.struct(F.when(d % 11 == 0, "made").otherwise("generated").alias("source")).alias("provenance"), F.struct(F.lit("a/b").alias("repo"), F.lit("0").alias("sha")).alias("target"),
        F.struct(some("src/net/retry.rs:Queue.flushQueue").alias("funcs"), some("src/net/retry.rs").alias("files")).alias("gold"),
    )


@query(f"WITH {_TRACES}, x AS (SELECT *, {_TIER} AS want, count(*) OVER (PARTITION BY id) AS times FROM t), p AS (SELECT id, unnest([CASE WHEN tier IS NULL THEN 'missing tier' END, CASE WHEN tier IS NOT NULL AND tier NOT IN ('blind', 'guess', 'golden') THEN 'unknown tier' END, CASE WHEN tier IS NOT NULL AND source NOT IN ('harvested', 'generated', 'cosqa') THEN 'unknown source' END, CASE WHEN tier IS NOT NULL AND trim(query) = '' THEN 'empty query' END, CASE WHEN tier IS NOT NULL AND want IS NULL THEN 'no gold' END, CASE WHEN tier IN ('blind', 'guess', 'golden') AND want <> tier THEN 'other tier' END, CASE WHEN times > 1 THEN 'repeated id' END]) AS problem FROM x) SELECT id, problem FROM p WHERE problem IS NOT NULL")
def trace_validation(spark, sf_dir):
    return reports.trace_problems(_traces(spark, sf_dir))


@query(f"WITH {_TRACES} SELECT v.tier, count(x.tier) AS n FROM (VALUES ('blind'), ('guess'), ('golden')) v(tier) LEFT JOIN (SELECT {_TIER} AS tier FROM t) x ON x.tier = v.tier GROUP BY v.tier")
def trace_tiers(spark, sf_dir):
    rows = _traces(spark, sf_dir)
    return evaluation.tier_counts(rows.select(reports.tier(F.col("query"), F.col("gold.funcs"), F.col("gold.files")).alias("tier")))


@query("WITH r AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'golden' WHEN quality = 1 THEN 'guess' ELSE 'blind' END AS tier, (doc_id * 7 % 13)::INT AS rank, CASE WHEN doc_id % 29 = 0 THEN 'no-tree' END AS skipped, (doc_id * 5 % 11)::INT AS was FROM labels) SELECT tier, count(*) FILTER (WHERE skipped IS NULL) AS n, count(*) FILTER (WHERE skipped IS NOT NULL) AS n_skipped, round(avg((rank = 1)::INT) FILTER (WHERE skipped IS NULL), 6) AS recall_1, round(avg((rank BETWEEN 1 AND 5)::INT) FILTER (WHERE skipped IS NULL), 6) AS recall_5, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0 / rank ELSE 0 END) FILTER (WHERE skipped IS NULL), 6) AS mrr_10, round(avg((rank BETWEEN 1 AND 5)::INT - (was BETWEEN 1 AND 5)::INT) FILTER (WHERE skipped IS NULL AND id % 3 <> 0), 6) AS delta_5, count(*) FILTER (WHERE skipped IS NULL AND id % 3 <> 0 AND (rank BETWEEN 1 AND 5) AND NOT (was BETWEEN 1 AND 5)) AS better, count(*) FILTER (WHERE skipped IS NULL AND id % 3 <> 0 AND NOT (rank BETWEEN 1 AND 5) AND (was BETWEEN 1 AND 5)) AS worse FROM r GROUP BY tier")
def tiered_replay(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels")
    ranks = rows.select(d.alias("id"), F.when(F.col("toxic") == 1, "golden").when(F.col("quality") == 1, "guess").otherwise("blind").alias("tier"), (d * 7 % 13).cast("int").alias("rank"), F.when(d % 29 == 0, "no-tree").alias("skipped"))
    base = rows.where("doc_id % 3 <> 0").select(d.alias("id"), (d * 5 % 11).cast("int").alias("rank"))
    return rounded(reports.replay(ranks, base), "recall_1", "recall_5", "mrr_10", "delta_5")


_CELLS = "c AS (SELECT 'run' || (c_custkey % 5) AS run, 'corpus' || (c_custkey // 5 % 4) AS corpus, CASE c_custkey % 3 WHEN 0 THEN 'bm25' ELSE 'hybrid' END AS mode, 'k' || (c_custkey // 20 % 7) AS kind, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey * 37 % 100) / 100.0 END AS recall_5, c_custkey % 6 AS n_ranks FROM customer)"


def _cells(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("run"), (k % 5).cast("string")).alias("run"), F.concat(F.lit("corpus"), (F.floor(k / 5) % 4).cast("string")).alias("corpus"), F.when(k % 3 == 0, "bm25").otherwise("hybrid").alias("mode"), F.concat(F.lit("k"), (F.floor(k / 20) % 7).cast("string")).alias("kind"), F.when(k % 8 != 0, (k * 37 % 100) / 100.0).alias("recall_5"), (k % 6).alias("n_ranks"))


def _best(cells, run):
    return cells.where(F.col("run") == run).groupBy("corpus", "mode", "kind").agg(F.max("recall_5").alias("recall_5"))


@query(f"WITH {_CELLS}, b AS (SELECT corpus, mode, kind, max(recall_5) AS base FROM c WHERE run = 'run1' GROUP BY ALL), d AS (SELECT corpus, mode, kind, max(recall_5) AS cand FROM c WHERE run = 'run2' GROUP BY ALL) SELECT corpus, mode, kind, round(base, 6) AS base, round(cand, 6) AS cand, round(cand - base, 6) AS delta FROM b JOIN d USING (corpus, mode, kind) WHERE base IS NOT NULL AND cand IS NOT NULL")
def ab_table(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return rounded(reports.ab_table(_best(cells, "run1"), _best(cells, "run2"), "recall_5"), "base", "cand", "delta")


@query(f"WITH {_CELLS}, b AS (SELECT corpus, mode, kind, max(recall_5) AS base FROM c WHERE run = 'run1' GROUP BY ALL), d AS (SELECT corpus, mode, kind, max(recall_5) AS cand FROM c WHERE run = 'run2' GROUP BY ALL), t AS (SELECT cand - base AS delta FROM b JOIN d USING (corpus, mode, kind) WHERE base IS NOT NULL AND cand IS NOT NULL) SELECT count(*) AS n, round(avg(delta), 6) AS mean, count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta < 0) AS down, count(*) FILTER (WHERE delta = 0) AS flat FROM t")
def ab_summary(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return rounded(reports.ab_summary(reports.ab_table(_best(cells, "run1"), _best(cells, "run2"), "recall_5")), "mean")


@query(f"WITH {_CELLS} SELECT run, count(recall_5) AS n_cells, sum(n_ranks)::BIGINT AS n_ranks, CASE run WHEN 'run0' THEN NULL WHEN 'run1' THEN 'first set' ELSE 'unknown (fp ' || 'fp' || right(run, 1) || ')' END AS query_set, run <> 'run3' AS recorded FROM c GROUP BY run")
def result_rollup(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    cells = cells.withColumn("queries_fp", F.when(F.col("run") != "run0", F.concat(F.lit("fp"), F.substring("run", 4, 1)))).withColumn("corpus", F.when(F.col("run") != "run3", F.col("corpus")))
    return reports.roll_up(cells, spark.createDataFrame([("fp1", "first set"), ("fp9", "other")], "queries_fp string, name string"))


@query("WITH q AS (SELECT 'k' || (doc_id % 3) AS kind, doc_id // 3 AS ordinal, CASE WHEN doc_id % 10 <> 0 THEN quality = 1 END AS is_blind FROM labels), c AS (SELECT m AS mode, kind, ordinal, ((ordinal * 7 + length(m)) % 12)::INT AS rank FROM q, (VALUES ('bm25'), ('hybrid')) v(m)) SELECT mode, kind, CASE WHEN is_blind THEN 'blind' ELSE 'named' END AS stratum, count(*) AS n, round(avg((rank BETWEEN 1 AND 5)::INT), 6) AS recall_5 FROM c JOIN q USING (kind, ordinal) WHERE is_blind IS NOT NULL GROUP BY ALL")
def blind_recut(spark, sf_dir):
    d = F.col("doc_id")
    q = table(spark, sf_dir, "labels").select(F.concat(F.lit("k"), (d % 3).cast("string")).alias("kind"), F.floor(d / 3).alias("ordinal"), F.when(d % 10 != 0, F.col("quality") == 1).alias("is_blind")).dropDuplicates(["kind", "ordinal"])
    cells = q.select(F.explode(F.array(F.lit("bm25"), F.lit("hybrid"))).alias("mode"), "kind", "ordinal").withColumn("rank", ((F.col("ordinal") * 7 + F.length("mode")) % 12).cast("int"))
    if reports.misfits(cells, q).limit(1).count():
        raise ValueError("the run was filtered")
    return rounded(reports.blind_cut(cells, q), "recall_5")


_SCHEDULE = [("click", "user"), ("purchase", "user"), ("never", "idle"), ("view", "user")]


@query("SELECT i::INT AS place, s AS stage, b AS bucket, round(coalesce((SELECT sum(value) FROM events WHERE event_type = s), 0), 4) AS ms FROM (VALUES (0, 'click', 'user'), (1, 'purchase', 'user'), (2, 'never', 'idle'), (3, 'view', 'user')) v(i, s, b)")
def stage_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").cast("double").alias("ms"))
    return reports.stage_sums(rows, _SCHEDULE).withColumn("ms", F.round("ms", 4))


@query(O.with_(*_BM25, O.scored(), O.ranked("scored", "top", 10), "shown AS (SELECT query_id, rank, tokens FROM top JOIN tok USING (path, start_line))", "n AS (SELECT query_id, count(*) AS n FROM shown GROUP BY query_id)", "seen AS (SELECT q.query_id, q.term, count(s.rank) AS seen FROM qterms q LEFT JOIN shown s ON s.query_id = q.query_id AND list_contains(s.tokens, q.term) GROUP BY ALL)", select="SELECT query_id, term FROM seen JOIN n USING (query_id) WHERE n < 6 OR seen <= ceil(n * 0.35)"))
def emphasis_terms(spark, sf_dir):
    every = tokens(spark, sf_dir)
    shown = lexical.bm25(every, asked(spark), 10).join(every.select(*KEY, "tokens"), KEY).select("query_id", F.col("rank").alias("row"), "tokens")
    return reports.emphasis(shown, lexical.query_terms(asked(spark)).select("query_id", "term"))


@query("SELECT doc_id AS i, m AS mode FROM labels, (VALUES ('bm25'), ('hybrid')) v(m) WHERE NOT (doc_id % 3 = 0 AND m = 'bm25')")
def resume_checkpoint(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"), F.explode(F.array(F.lit("bm25"), F.lit("hybrid"))).alias("mode"))
    header = {"queries_fp": "x", "modes": ["bm25", "hybrid"], "corpus": "c"}
    return reports.resumed(wanted, wanted.where("i % 3 = 0 AND mode = 'bm25'").withColumn("rank", F.lit(1)), header, dict(header))


@query("SELECT doc_id, 'q|toxic=' || toxic AS cell FROM labels WHERE quality = 1 AND toxic = 0")
def where_stratify(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("kind", F.lit("q"))
    kept = reports.selected(rows, "quality=1, toxic=0")
    return kept.select("doc_id", reports.cell(kept, ["toxic"]).alias("cell"))


@query("SELECT 'r' || s_suppkey AS run, CASE WHEN s_suppkey % 5 = 0 THEN 'corpus is gone' WHEN s_suppkey % 3 = 0 THEN 'corpus has changed' ELSE 'index is older' END AS reason FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def stale_results(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    results = rows.select(F.concat(F.lit("r"), k.cast("string")).alias("run"), k.alias("corpus"), F.when(k % 3 == 0, "old").otherwise("new").alias("corpus_digest"), F.when(k % 2 == 0, 1).otherwise(9).alias("written"))
    live = rows.where("s_suppkey % 5 <> 0").select(k.alias("corpus"), F.lit("new").alias("digest"), F.lit(5).alias("changed"))
    return reports.stale(results, live)


@query(O.with_(O.FILES, O.LS, O.CHUNKS, select="SELECT (SELECT count(*) FROM files) AS n_files, (SELECT sum(size)::BIGINT FROM files) AS bytes_indexed, (SELECT count(*) FROM chunks) AS n_chunks, 4.5::DOUBLE AS accounted_ms"))
def build_envelope(spark, sf_dir):
    return reports.envelope(files(spark, sf_dir), chunks(spark, sf_dir), spark.createDataFrame([("walk", 1.5), ("embed", 3.0)], "stage string, ms double"))


@query(O.with_(O.FILES, O.LS, select="SELECT path, left(sha256(array_to_string(ls[1:3], chr(10))), 16) AS span_sha FROM ls"))
def span_sha(spark, sf_dir):
    f = files(spark, sf_dir)
    spans = corpus.read_lines(f, f.select("path", F.lit(1).alias("start_line"), F.lit(3).alias("end_line")))
    return spans.select("path", F.substring(F.sha2("body", 256), 1, 16).alias("span_sha"))
