import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, display, evaluation, finalize
from quarry.operators.finalize import Finalize, Row
from quarry.sources import corpus


def test_phrases():
    assert T.split_phrases("a b") == ["a b"]
    assert T.split_phrases(" a ") == [" a "]
    assert T.split_phrases("a|b\\|c") == ["a", "b", "c"]
    assert T.split_phrases("a||b") == ["a||b"]
    assert T.split_phrases("|") == ["|"]
    assert len(T.split_phrases("|".join("abcdefghijkl"))) == 8
    assert T.parse_lines("3-5") == (3, 5) and T.parse_lines("7-")[0] == 7 and T.parse_lines("-4") == (1, 4)
    with pytest.raises(ValueError, match="empty"):
        T.parse_lines("5-3")


@pytest.mark.parametrize(("text", "want"), [("load_cargo_bay", ["load", "cargo", "bay"]), ("openBayDoor", ["open", "bay", "door", "openbaydoor"]), ("TLSHandshakeTimer q", ["tls", "handshake", "timer", "tlshandshaketimer"]), ("crc16ccitt vp9", ["crc16ccitt", "vp9"]), ("", []), ("Äpfel çà", ["äpfel", "çà"])])
def test_tokens_in_both_forms(spark, text, want):
    assert finalize.tokens(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(T.text_tokens(F.col("t"))).first()[0] == want


def test_globs(spark):
    paths = ["a.py", "src/a.py", "src/b.rs", "docs/x/y.md", "src/.hid/c.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = lambda *g: [r.path for r in df.where(T.glob_match(F.col("path"), list(g))).collect()]
    assert got("*.py") == ["a.py", "src/a.py", "src/.hid/c.py"]
    assert got("src/") == ["src/a.py", "src/b.rs", "src/.hid/c.py"]
    assert got("/a.py") == ["a.py"]
    assert got("!*.py") == ["src/b.rs", "docs/x/y.md"]
    assert got("src/**", "!*.rs") == ["src/a.py", "src/.hid/c.py"]
    assert got("docs/**/*.md") == ["docs/x/y.md"]


def test_budget_and_definition_spans_cover_every_line():
    rng = random.Random(3)
    for _ in range(40):
        lines = ["x" * rng.randrange(0, 30) for _ in range(rng.randrange(1, 60))]
        spans = chunking.budget_spans(lines, chunking.ChunkParams(budget=50))
        assert {i for a, b in spans for i in range(a, b + 1)} == set(range(1, len(lines) + 1))
        assert all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    code = "import os\n\n# lead\ndef one():\n    return 1\n\n\nclass A:\n    def two(self):\n        x = 1\n        y = 2\n        z = 3\n        return x\n\nprint(1)\n".split("\n")
    spans = chunking.definition_spans(code, 96, 32)
    assert (3, 5) in spans and (9, 13) in spans
    flat = [i for a, b in spans for i in range(a, b + 1)]
    assert flat == list(range(1, len(code) + 1))


def test_windows_equal_a_loop(spark):
    for n in (0, 1, 7, 24, 32, 33, 56, 57, 90):
        text = "\n".join(f"l{i}" for i in range(n))
        f = spark.createDataFrame([("p", len(text), 0, text)], "path string, size long, mtime long, text string")
        want, a = [], 0
        while n and True:
            want.append((a + 1, min(a + 32, n)))
            if a + 32 >= n:
                break
            a += 24
        assert [(r.start_line, r.end_line) for r in chunking.window_chunks(f).orderBy("start_line").collect()] == want


def test_passages_and_units():
    lines = [f"line {i}" for i in range(50)]
    low, high = display.passage(lines, 20, 100)
    assert low <= 20 <= high and sum(len(lines[i]) + 12 for i in range(low, high + 1)) <= 100
    assert display.passage(["x" * 5000], 0) == (0, 0)
    code = ["class Store:", '    """Keeps things."""', "", "    def put(self, k):", "        self.a = k", "        self.b = k", "    }", "}"]
    shown = [i for i, _ in display.unit_view(code, 4, 5, "x.py")]
    assert {3, 4, 5} <= set(shown)
    assert display.declared_names("pub fn alpha(x) { let mut beta = 1; }") == ["alpha", "beta"]
    assert display.declaration_tokens("def get_it(one, two):\n    three = 4\n    if five == 6:") == ["get", "it", "one", "two", "three"]
    assert display.dedented(["    a", "        b", "", "    c"]) == ["a", "  b", "", "c"]


def pool(n=20, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "retry", "token"]) for _ in range(6)) for _ in range(12)]
        row = Row(f"f{i % 7}.txt", 1 + 40 * i, 12 + 40 * i, lines, 1.0 - i / n, 1 + i % 2 + (i % 3 == 0), i + 1 if i % 4 == 0 else None)
        row.phrases = max(1, row.phrases & 3)
        row.vector = finalize.embed("\n".join(lines), 32)
        out.append(row)
    return out


def test_finalize_keeps_its_guarantees():
    rows = pool()
    got = finalize.finalize(rows, ["alpha beta", "retry token"], Finalize(k=6))
    assert len(got) == 6 and len({(r.path, r.start) for r, _ in got}) == 6
    assert {r.fine[3] for r, _ in got} == {0, 1}
    pins = {r.start for r in rows if r.bm25_rank is not None and r.bm25_rank <= 5}
    assert pins <= {r.start for r, _ in got}
    assert [(r.start, s) for r, s in got] == [(r.start, s) for r, s in finalize.finalize(rows, ["alpha beta", "retry token"], Finalize(k=6))]
    assert finalize.finalize(rows, ["alpha"], Finalize(min_score=1.5)) == []
    assert finalize.finalize([], ["alpha"], Finalize()) == []


def test_rerank_is_a_permutation_and_dedupe_merges():
    rows = pool()
    again, relevance, _ = finalize.fine_rerank([Row(**{f: getattr(r, f) for f in r.__dataclass_fields__}) for r in rows], [finalize.embed("alpha", 32)], Finalize())
    assert sorted(r.start for r in again) == sorted(r.start for r in rows) and len(relevance) == len(rows)
    a, b = Row("p", 1, 10, ["x"] * 10, 1.0, 1, 9), Row("p", 8, 20, ["x"] * 13, 0.5, 2, 3)
    (kept,) = finalize.dedupe([a, b], 0.0)
    assert kept.phrases == 3 and kept.bm25_rank == 3
    assert len(finalize.dedupe([Row("p", 1, 10, ["x"], 1.0), Row("p", 8, 20, ["x"], 0.5)], 0.5)) == 2


def test_mmr_spreads():
    v = [np.array([1.0, 0.0]), np.array([1.0, 0.01]), np.array([0.0, 1.0])]
    assert finalize.mmr([1.0, 0.95, 0.9], v, 2, 0.5)[1] == 2
    assert finalize.mmr([1.0, 0.95, 0.5], v, 3, 1.0) == [0, 1, 2]


def test_paired_statistics():
    assert evaluation.sign_test(0, 0) == 1.0 and evaluation.sign_test(5, 5) == 1.0
    assert abs(evaluation.sign_test(9, 1) - 0.021484375) < 1e-12
    low, high = evaluation.bootstrap(np.array([1.0, 0, 0, 1, 1, 1, 0, 1]))
    assert 0 <= low < 0.625 < high <= 1
    assert evaluation.attempts("how getUserName works", True)[0] == "getUserName"


def test_folder_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a b.py").write_text("x = 1\r\ny = 2\n")
    (tmp_path / "bin").write_bytes(b"a\0b")
    (tmp_path / ".git" / "c").write_text("hidden")
    (tmp_path / "big.txt").write_text("z" * 500)
    files = corpus.from_folder(spark, str(tmp_path), max_bytes=400)
    assert [r.path for r in files.collect()] == ["src/a b.py"]
    assert [(r.line_no, r.line) for r in corpus.lines(files).orderBy("line_no").collect()] == [(1, "x = 1"), (2, "y = 2")]
    assert corpus.common_ancestor(["a/b/c", "a/b/d/e"]) == "a/b"


def test_ignore_files(spark, tmp_path):
    for name, text in {".gitignore": "*.log\nout/\n!keep.log\n", "a.log": "x", "keep.log": "x", "out/b.txt": "x", "src/.ignore": "!a.log\nsecret*\n", "src/a.log": "x", "src/secret.txt": "x", "src/c.txt": "x", "src/__init__.py": "x", "src/_d/e.py": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    names = lambda **how: sorted(r.path for r in corpus.from_folder(spark, str(tmp_path), **how).collect())
    assert names() == ["keep.log", "src/__init__.py", "src/_d/e.py", "src/a.log", "src/c.txt"]
    assert names(ignored=False) == ["a.log", "keep.log", "out/b.txt", "src/__init__.py", "src/_d/e.py", "src/a.log", "src/c.txt", "src/secret.txt"]


def test_leakage_names_the_gold(spark):
    gold = 'def flushQueue(n):\n    """Drains pending work."""\n    # retry later\n    max_size = n\n'
    rows = [(1, "where is flushQueue and max_size", "core/queue/drain.py", gold, "flushQueue"), (2, "flushing the drain of core", "core/queue/drain.py", gold, "flush"), (3, "pending work", "a/io.py", gold, "pendingQueue"), (4, "Queue", "a/io.py", gold, "flushQueue"), (5, "", "x.py", "", "")]
    found = evaluation.blind(evaluation.leakage(spark.createDataFrame(rows, "query_id long, query string, gold_path string, gold_text string, symbol string")))
    got = {r.query_id: r for r in found.collect()}
    assert [got[i].gold_id_hits for i in range(1, 6)] == [2, 1, 0, 1, 0]
    assert [got[i].has_identifier for i in range(1, 6)] == [True, False, False, False, False]
    assert got[2].path_seg_in_query and got[2].path_seg_not_in_gold and got[2].stem_in_query and not got[1].stem_in_query and not got[3].path_seg_in_query
    assert got[3].gold_token_overlap == 1.0 and not got[3].is_blind and not got[1].is_blind and got[5].gold_token_overlap == 0.0


def test_minable_paths(spark):
    from quarry.operators.lexical import NOT_MINABLE, minable

    paths = ["a.py", "LICENSE", "b.MD", "c.lock", "go.sum", "x.d/run"] + [f"z.{e}" for e in NOT_MINABLE]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.where(minable(F.col("path"))).collect()] == ["a.py", "LICENSE", "x.d/run"] and len(NOT_MINABLE) == 24 and len(evaluation.STOPWORDS) == 33


def test_reports_refuse_what_they_cannot_answer(spark, tmp_path):
    from quarry.operators import reports

    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "kind string, n int, extra string")
    assert [r.n for r in reports.selected(rows, "n=2,extra=X").collect()] == [2] and reports.selected(rows, "").count() == 2
    assert [r[0] for r in rows.select(reports.cell(rows, ["extra"])).collect()] == ["a|extra=none", "b|extra=x"]
    for wrong in (lambda: reports.selected(rows, "gone=1"), lambda: reports.selected(rows, "n"), lambda: reports.cell(rows, ["gone"]), lambda: reports.resumed(rows, rows, {"a": 1}, {"a": 2})):
        with pytest.raises(ValueError, match=r"\S"):
            wrong()
    path = str(tmp_path / "traces")
    reports.append_rows(spark.createDataFrame([("t1", "where is net", "guess", ("cosqa",), ("a/b", "0"), ([], ["src/net/x.rs"]))], reports.TRACE_ROW), path)
    reports.append_rows(spark.createDataFrame([("t2", None, "blind", ("cosqa",), ("a/b", "0"), (["f.rs:A.flush_it"], None))], reports.TRACE_ROW), path)
    back = reports.read_rows(spark, path, reports.TRACE_ROW)
    assert sorted((r.id, r.problem) for r in reports.trace_problems(back).collect()) == [("t2", "missing query")]
    cells = spark.createDataFrame([("bm25", "k", 0, 1), ("bm25", "k", 1, 0)], "mode string, kind string, ordinal long, rank int")
    queries = spark.createDataFrame([("k", 0, True), ("k", 1, None), ("k", 2, False)], "kind string, ordinal long, is_blind boolean")
    assert [(r.mode, r.kind) for r in reports.misfits(cells, queries).collect()] == [("bm25", "k")]
    assert [(r.stratum, r.n, r.recall_5) for r in reports.blind_cut(cells, queries).collect()] == [("blind", 1, 1.0)]


def test_digest_of_a_query_set_goes_by_order(spark):
    one = spark.createDataFrame([("k", i, f"q{i}") for i in range(50)], "kind string, query_id long, query string")
    two = spark.createDataFrame([("k", i, f"q{i}") for i in reversed(range(50))], "kind string, query_id long, query string")
    prints = [evaluation.manifest(df, 8).first().fingerprint for df in (one, two, one.where("query_id > 0"))]
    assert prints[0] == prints[1] != prints[2]
