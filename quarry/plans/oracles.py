"""DuckDB SQL that must give the rows of the registered queries: written from the definitions, not from the plans."""

from __future__ import annotations


def tokens(text: str, whole: bool = True) -> str:
    """An expression for the code-aware tokens of a text expression."""
    parts = r"string_split(regexp_replace(regexp_replace(w, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' ')"
    each = f"CASE WHEN len({parts}) > 1 THEN list_append({parts}, w) ELSE {parts} END" if whole else parts
    return rf"list_transform(list_filter(flatten(list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+'), lambda w: {each})), lambda t: length(t) >= 2), lambda t: lower(t))"


FILES = "files AS (SELECT concat_ws('/', lang, source, doc_id::VARCHAR || '.txt') AS path, strlen(text)::BIGINT AS size, 0::BIGINT AS mtime, text FROM documents)"
LS = r"ls AS (SELECT path, list_transform(CASE WHEN p[len(p)] = '' THEN p[1 : len(p) - 1] ELSE p END, lambda x: regexp_replace(x, '\r$', '')) AS ls FROM (SELECT path, string_split(text, chr(10)) AS p FROM files))"
LINES = "lines AS (SELECT path, i::INT AS line_no, ls[i] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls))"
CHUNKS = r"chunks AS (SELECT * FROM (SELECT path, (a + 1)::INT AS start_line, least(a + 32, len(ls))::INT AS end_line, array_to_string(ls[a + 1 : a + 32], chr(10)) AS body FROM (SELECT path, ls, unnest(list_filter(range(0, len(ls), 24), lambda a: a = 0 OR a + 8 < len(ls))) AS a FROM ls WHERE len(ls) > 0)) WHERE regexp_matches(body, '\S'))"
TOKENS = f"tok AS (SELECT path, start_line, end_line, {tokens('path || chr(10) || body')} AS tokens FROM chunks)"
TERMS = "terms AS (SELECT path, start_line, dl, term, least(count(*), 65535)::INT AS tf FROM (SELECT path, start_line, len(tokens)::BIGINT AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL)"
STATS = "stats AS (SELECT term, count(*) AS df FROM terms GROUP BY term)"
CORPUS = "corpus AS (SELECT count(*) AS n_docs, coalesce(sum(len(tokens)), 0)::BIGINT AS total_len, greatest(CASE WHEN count(*) > 0 THEN sum(len(tokens)) / count(*) ELSE 1 END, 1)::DOUBLE AS avgdl FROM tok)"
BASE = [FILES, LS, CHUNKS, TOKENS, TERMS, STATS, CORPUS]
IDF = "ln((n_docs - df + 0.5) / (df + 0.5) + 1)"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def queries(rows: list[tuple[int, str]]) -> str:
    return "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in rows) + ") v(query_id, phrase))"


QTERMS = f"qterms AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({tokens('phrase')}) AS term FROM queries) GROUP BY ALL)"


def scored(name: str = "scored", wanted: str = "qterms", scope: str = "true") -> str:
    return f"{name} AS (SELECT query_id, path, start_line, sum(weight * {IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM terms JOIN {wanted} USING (term) JOIN stats USING (term), corpus WHERE {scope} GROUP BY query_id, path, start_line)"


def ranked(source: str, name: str, k: int, order: str = "round(score, 9) DESC, path, start_line") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INT AS rank FROM {source}) WHERE rank <= {k})"


#: Vectors of tokens from their MD5s, pooled by text.
def hash_component(term: str, d: str) -> str:
    return f"(('0x' || substr(md5({term} || '#' || {d}), 1, 8))::BIGINT / 2147483647.5 - 1)"


UNIT = "list_transform({v}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))))"
QUANT = "list_transform({v}, lambda x: greatest(-127, least(127, round(x * 127)))::TINYINT)"

#: Pooled vectors of chunks (cq) and of queries (qq), quantized, and the nearest chunks of each query (sem).
_D = range(32)
_TV = ", ".join(f"{hash_component('term', repr(str(d)))} AS h{d}" for d in _D)
_NORM = "sqrt(" + " + ".join(f"v{d} * v{d}" for d in _D) + ")"
_Q = "[" + ", ".join(f"greatest(-127, least(127, round(v{d} / {_NORM} * 127)))::INT" for d in _D) + "]"


def pooled(name: str, key: str, source: str, n: str, weight: str = "1.0", mean: str = "") -> str:
    """name AS key, v0..v31: means of the vectors of source's terms, counted n times, weighed, less a mean."""
    parts = ", ".join(f"sum({n} * {weight} * h{d}) / sum({n} * {weight}){f' - {mean}{d}' if mean else ''} AS v{d}" for d in _D)
    return f"{name} AS (SELECT {key}, {parts} FROM {source} GROUP BY {key})"


TV = f"tv AS (SELECT term, {_TV} FROM (SELECT term FROM terms UNION SELECT term FROM qterms))"
SEMANTIC = [
    TV, pooled("cv", "path, start_line", "terms JOIN tv USING (term)", "tf"), pooled("qv", "query_id", "qterms JOIN tv USING (term)", "weight"),
    f"cq AS (SELECT path, start_line, {_Q} AS q FROM cv)", f"qq AS (SELECT query_id, {_Q} AS q FROM qv)",
    "near AS (SELECT query_id, path, start_line, 1 - list_sum(list_transform(list_zip(cq.q, qq.q), lambda p: p[1] * p[2])) / (127.0::DOUBLE * 127.0::DOUBLE) AS distance FROM cq, qq)",
    ranked("near", "sem", 128, "distance, path, start_line"),
]
