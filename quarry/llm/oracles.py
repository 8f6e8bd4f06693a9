"""DuckDB SQL of the training-data queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

OP9 = rf"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM docs),
i AS (SELECT item_id, ws, least(len(ws), 5) AS k, greatest(len(ws) - 4, 1) AS m FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE len(ws) > 0),
ig AS (SELECT item_id, k, m, g, count(*) AS weight FROM (SELECT item_id, k, m, unnest(list_transform(range(1, m + 1), lambda p: array_to_string(ws[p : p + k - 1], ' '))) AS g FROM i) GROUP BY ALL),
dg AS (SELECT r, doc_id, k, len(ws) - k + 1 AS n, p - 1 AS pos, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT r, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)),
hit AS (SELECT r, doc_id, item_id, n, m, pos, g, weight FROM dg JOIN ig USING (k, g)),
likely AS (SELECT r, item_id, least(n, m) AS w FROM hit GROUP BY r, item_id, n, m HAVING count(*) * 1.8 >= 0.8 * (m + least(n, m))),
start AS (SELECT DISTINCT r, doc_id, item_id, m, w, least(pos, n - w) AS p FROM hit JOIN likely USING (r, item_id)),
part AS (SELECT s.r, s.doc_id, s.item_id, s.m, s.w, s.p, h.g, least(count(*), any_value(h.weight)) AS c FROM start s JOIN hit h ON h.r = s.r AND h.item_id = s.item_id AND h.pos >= s.p AND h.pos < s.p + s.w GROUP BY s.r, s.doc_id, s.item_id, s.m, s.w, s.p, h.g),
best AS (SELECT r, doc_id, item_id, m, w, p, sum(c)::BIGINT AS s FROM part GROUP BY ALL)
SELECT doc_id, item_id, round(max(s / (m + w - s)), 6) AS similarity FROM best WHERE s * 1.8 >= 0.8 * (m + w) GROUP BY r, doc_id, item_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op3() -> str:
    from quarry.llm import licenses

    def canonical(text: str) -> str:
        text = rf"regexp_replace(lower({text}), '{licenses._COPYRIGHT}', '\1', 'g')"
        for a, b in licenses.SPELLINGS:
            text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
        return f"trim(regexp_replace({text}, '{licenses._OTHER}', ' ', 'g'))"

    values = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(licenses.KNOWN))
    digests = ", ".join(f"({len(licenses.KNOWN) + i}, {_quoted(k)}, {_quoted(d)})" for i, (k, d) in enumerate(licenses.DIGESTS))
    return f"""
WITH known AS (SELECT digest, min_by(license, i) AS license FROM (SELECT i, license, sha256({canonical("t")}) AS digest FROM (VALUES {values}) v(i, license, t) UNION ALL SELECT * FROM (VALUES {digests}) w(i, license, digest)) GROUP BY 1),
docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT row_number() OVER () AS r, doc_id, text FROM docs),
pieces AS (SELECT r, doc_id, true AS whole, text AS part FROM r UNION ALL SELECT r, doc_id, false, unnest(string_split(text, chr(10))) FROM r),
canonical AS (SELECT r, doc_id, whole, {canonical("part")} AS part FROM pieces),
found AS (SELECT c.r, c.doc_id, c.whole, sha256(c.part) AS digest, k.license FROM canonical c LEFT JOIN known k ON k.digest = sha256(c.part) AND c.part <> '')
SELECT doc_id, max(digest) FILTER (WHERE whole) AS digest, max(license) FILTER (WHERE whole) AS license,
  count(license) FILTER (WHERE NOT whole) AS n_license_lines,
  coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (WHERE NOT whole AND license IS NOT NULL)), ','), '') AS line_licenses
FROM found GROUP BY r, doc_id
"""
