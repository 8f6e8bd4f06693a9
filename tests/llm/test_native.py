"""The two operators that keep to DataFrame functions, against plain Python."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, licenses, oracles
from quarry.llm.registry import op3_licenses, op9_decontaminate
from tests.llm.helpers import frame, rows


def grams(ws, k):
    return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, similarity=0.8):
    out = set()
    for i, text in {(d[0], d[1] or "") for d in docs}:
        ws = tokens(text)
        for j, item in items:
            it = tokens(item)
            if not it or j is None:
                continue
            k, n = min(5, len(it)), len(it)
            want, best = Counter(grams(it, k)), 0
            for p in range(len(ws) - n + 1):
                have = Counter(grams(ws[p : p + n], k))
                best = max(best, sum((want & have).values()) / sum((want | have).values()))
            if best >= similarity - 1e-12:
                out.add((i, j, round(best, 6)))
    return out


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_contaminated_equals_brute_force(spark):
    data = rows()
    base = tokens(data[3][1] + " " + data[4][1] + " " + data[5][1])[:60]
    edited = [*base[:58], "zzz", "yyy"]
    data += [(5000, " . ".join(base) + " and more", None, None, None), (5001, "pre " + " ".join(edited), None, None, None), (5002, " ".join(w if i % 9 else "q" for i, w in enumerate(base)), None, None, None), (5003, "the short item, twice: the SHORT item", None, None, None)]
    items = [(1, " ".join(base)), (2, "The short ITEM"), (3, None), (4, "..."), (5, "one"), (6, "ab " * 20), (None, "one"), (7, " ".join(base[:30] * 2))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 3):
        found = decontaminate.contaminated(frame(spark, data), bench, broadcast_grams=limit)
        assert "Python" not in plan_of(found)
        assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in found.collect()} == brute(data, items)
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, data), bench.limit(0)).count() == 0


def brute_short(docs, items, similarity=0.8):
    """Of documents shorter than the item: the whole document is the window."""
    out = set()
    for i, text in {(d[0], d[1] or "") for d in docs}:
        ws = tokens(text)
        for j, item in items:
            it = tokens(item)
            k = min(5, len(it))
            want, have = Counter(grams(it, k)), Counter(grams(ws, k))
            like = sum((want & have).values()) / sum((want | have).values())
            if len(ws) < len(it) and like >= similarity - 1e-12:
                out.add((i, j, round(like, 6)))
    return out


def test_documents_shorter_than_the_item(spark):
    base = [f"w{i}" for i in range(30)]
    cuts = [(a, b) for a in range(5) for b in range(22, 31) if b - a < 30]
    data = [(n, " ".join(base[a:b]), None, None, None) for n, (a, b) in enumerate(cuts)]
    data += [(100, " ".join(["x", *base[:28]]), None, None, None), (101, " ".join(base[:4]), None, None, None), (102, "one two", None, None, None), (103, "", None, None, None)]
    items = [(1, " ".join(base)), (2, "one two three"), (3, " ".join(base[:10] * 3))]
    want = brute_short(data, items)
    assert (cuts.index((0, 28)), 1, round(24 / 26, 6)) in want and len(want) < len(cuts)
    found = decontaminate.contaminated(frame(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in found.collect()} == want | brute(data, items)


def test_texts_of_two_words_in_turn(spark):
    pairs = [(f"a{i}", f"b{i}") for i in range(8)]
    items = [(i, " ".join([x, y] * 11 + [x])) for i, (x, y) in enumerate(pairs)]
    data = [(i, " ".join([y, x] * 11 + [y]), None, None, None) for i, (x, y) in enumerate(pairs)]
    want = brute(data, items)
    assert want == {(i, i, 0.9) for i in range(8)}
    found = decontaminate.contaminated(frame(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in found.collect()} == want


def test_a_text_of_one_word_costs_its_length(spark):
    import time

    item, data = "ab " * 20, [(1, "ab " * 20_000, None, None, None), (2, "ab cd " * 9_000, None, None, None), (3, "ab " * 25, None, None, None)]
    bench = spark.createDataFrame([(1, item), (2, "ab cd " * 12)], "item_id long, text string")
    began = time.time()
    found = sorted((r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(frame(spark, data), bench).collect())
    assert time.time() - began < 10
    assert found == [(1, 1, 1.0), (2, 2, 1.0), (3, 1, 1.0)]


def test_random_texts_of_few_words(spark):
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    data = [(i, draw(rng.randrange(3, 70)), None, None, None) for i in range(60)]
    items = [(i, draw(rng.randrange(3, 30))) for i in range(12)]
    found = decontaminate.contaminated(frame(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(data, items) | brute_short(data, items)
    assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in found.collect()} == want and len(want) > 30


def test_texts_that_share_an_item_id(spark):
    texts = [" ".join(f"t{t}w{i}" for i in range(20)) for t in range(6)]
    data = [(i, "pre " + t, None, None, None) for i, t in enumerate(texts)] + [(9, texts[0].replace("t0w19", "x") + " " + texts[1], None, None, None)]
    bench = spark.createDataFrame([(1, t) for t in [*texts, texts[0]]], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, data), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == [(i, 1, 1.0) for i in [*range(6), 9]]


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    data = [(1, "Copyright (c) 2020 Someone\nCOPYRIGHT 1999 Else\n\n" + mit.replace(" ", "\n  ").replace('"', "'"), None, None, None), (2, f"words\nReleased under the MIT Licence\nx\n * Licensed under CC BY-NC 4.0\n", None, None, None), (3, None, None, None, None), (3, None, None, None, None), (4, " \n!!", None, None, None), (None, "MIT License", None, None, None), (5, mit + " changed", None, None, None)]
    found = licenses.scan(frame(spark, data))
    assert "Python" not in plan_of(found)
    got = sorted(((r.doc_id, r.license, r.n_license_lines, r.line_licenses) for r in found.collect()), key=str)
    assert got == sorted([(1, "MIT", 0, ""), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (None, "MIT", 1, "MIT"), (5, None, 0, "")], key=str)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_known_licences_take_no_python_worker(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "concat('MIT Licence', id) AS text")
    assert "ExistingRDD" not in plan_of(licenses.known(spark)) and "ExistingRDD" not in plan_of(licenses.scan(docs))
    texts, digests = [("A", "The Licence & more"), ("B", "the license AND more")], [("C", "0" * 64), ("D", "0" * 64)]
    named = {r.license for r in licenses.known(spark, texts, digests).collect()}
    assert named == {"A", "C"} and licenses.known(spark, (), ()).count() == 0
    assert {r.license for r in licenses.known(spark, (), digests).collect()} == {"C"}


def test_a_text_is_spelled_once_for_itself_and_its_lines(spark):
    lines = ["ΟΔΟΣ", "Σ", "(c) 2020 me", "x © y", "Copyright", "2020 copyright 1", "sub-", "licence", "İstanbul LICENCE\r", "non-commercial & per", "cent", "", "https://x.y", "MIT Licence", "\u2028(C)  1", "per cent"]
    rng = random.Random(3)
    data = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9))), None, None, None) for i in range(400)]
    docs = frame(spark, data)
    apart = docs.select("doc_id", F.transform(F.split("text", "\n"), licenses.canonical).alias("want"), F.transform(F.split(licenses.spelled(F.col("text")), "\n"), licenses.letters).alias("got"))
    assert apart.where("want <> got").count() == 0 and apart.count() == 400
    plain = F.regexp_replace(F.lower("text"), licenses._COPYRIGHT, "$1")
    for a, b in licenses.SPELLINGS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    assert docs.where(plain != licenses.spelled(F.col("text"))).count() == 0


def test_lines_of_rows_that_share_id_and_text_count_once(spark, tmp_path):
    data = [(7, "a\nMIT License\nMIT License", None, None, None)] * 3 + [(7, "MIT License", None, None, None), (None, "x\nMIT License", None, None, None), (None, "x\nMIT License", None, None, None)]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = op3_licenses(spark, str(tmp_path))
    assert dict(found.dtypes)["n_license_lines"] == "bigint"
    got = sorted(((r.doc_id, r.n_license_lines) for r in found.collect()), key=str)
    assert got == sorted(con.sql(f"SELECT doc_id, n_license_lines FROM ({oracles.op3()})").fetchall(), key=str) == [(7, 1), (7, 2), (None, 1)]


def test_whole_licences(spark):
    from pathlib import Path

    shelf, names = Path("/usr/share/common-licenses"), {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {f: (shelf / f).read_text() for f in names if (shelf / f).exists()}
    data = [(i, t, None, None, None) for i, t in enumerate(found.values())]
    data += [(100 + i, "  " + t.replace("License", "licence").replace("\n", "\r\n") + "\nCopyright (c) 2024 Me", None, None, None) for i, t in enumerate(found.values())]
    data += [(200 + i, t + " and one word more", None, None, None) for i, t in enumerate(found.values())]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, data)).collect()}
    for i, f in enumerate(found):
        assert got[i] == got[100 + i] == names[f] and got[200 + i] is None
    texts = [(300 + i, t.upper(), None, None, None) for i, (_, t) in enumerate(licenses.KNOWN)]
    assert {r.doc_id: r.license for r in licenses.scan(frame(spark, texts)).collect()} == {300 + i: k for i, (k, _) in enumerate(licenses.KNOWN)}
    assert all(re.fullmatch("[0-9a-f]{64}", d) for _, d in licenses.DIGESTS) and len({d for _, d in licenses.DIGESTS}) == len(licenses.DIGESTS)


@pytest.mark.parametrize(("query", "sql"), [(op3_licenses, oracles.op3()), (op9_decontaminate, oracles.OP9)])
def test_sql_gives_the_same_rows(spark, tmp_path, query, sql):
    data = rows()
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, data[4][1]), (2, data[9][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = query(spark, str(tmp_path)).toPandas()
    want = con.sql(sql).df()[list(got.columns)]
    def text(df):
        return sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df.itertuples(index=False))

    assert text(got) == text(want)
