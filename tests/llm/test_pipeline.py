from collections import defaultdict

import corpus_pipeline
from quarry.llm import packing, registry, secrets
from tests.llm.helpers import frame, rows
from tests.llm.test_native import brute as leaks
from tests.llm.test_simhash import brute as groups
from tests.llm.test_simhash import plain


def test_each_stage_equals_brute_force_on_what_the_one_before_kept(spark, tmp_path):
    data = [*rows(), (7000, "t token = abcdefghijkl9 end of it", "en", "s", 5)]
    data += [(7100 + i, f"{data[i][1]} grobnak grobzul idiot " + data[i + 1][1], "en", "s", 5) for i in range(40)]
    items = [(1, " ".join(data[7][1].split()[:40])), (2, " ".join(data[11][1].split()[:30]))]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(d[0], int("grobnak" in (d[1] or ""))) for d in data if d[0] is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = registry.toxicity_model(spark, docs, str(tmp_path))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    before = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted(map(tuple, docs.collect()), key=key)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            want = [r for r in before if model.score([(r[1] or "").encode()])[0] < 0.7]
            assert len(want) < len(before)
        elif name == "near_duplicates":
            root = groups([plain(r[1]) for r in before])
            best = {}
            for r in before:
                g = root[plain(r[1])]
                rank = (r[0] is None, r[0] or 0, *[(x is not None, x) for x in r[1:]])
                if g not in best or rank < best[g][0]:
                    best[g] = rank, r
            want = [r for _, r in best.values()]
        elif name == "decontamination":
            bad = {n for n, r in enumerate(before) if leaks([(0, r[1])], items)}
            want = [r for n, r in enumerate(before) if n not in bad]
            assert bad
        elif name == "secrets":
            want = [(r[0], None if r[1] is None else secrets.redacted(r[1]), r[2], r[3], None if r[4] is None or r[1] is None else len(secrets.redacted(r[1]))) for r in before]
            assert any("[SECRET]" in (r[1] or "") for r in want)
        else:
            pieces, places = defaultdict(list), defaultdict(list)
            for doc_id, start, length, crc, tokens, sequence, offset in got:
                pieces[doc_id].append((start, length, crc, tokens))
                places[sequence].append((offset, length))
            for doc_id, text, *_ in before:
                ids = packing.ids_of(text or "", packing.default_vocabulary())
                assert sorted(pieces[doc_id]) == [(a, len(ids[a : a + 1024]), packing.crc32_of(ids[a : a + 1024]), len(ids)) for a in range(0, len(ids), 1024)]
            for parts in places.values():
                parts.sort()
                assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 1024
            break
        assert got == sorted(want, key=key), name
        before = got


def test_run_gives_packed_rows(spark, tmp_path):
    frame(spark, rows()[:20]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_ids_that_repeat_and_names_that_clash(spark, tmp_path):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ant", "bee", "cat", "dog")]
    names = "doc_id long, text string, lang string, source string, n_chars long, _head string, row int, doc int, h int, fp int, digest int, i int, spans int, vec int"
    data = [(5, texts[0]), (5, texts[1]), (7, texts[2]), (8, texts[2] + " tail"), (None, texts[3]), (None, texts[3]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), f"x{n}", *[n] * 8) for n, (i, t) in enumerate(data)], names)
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [0, 1, 2, 4]
    spark.createDataFrame([(1, " ".join(texts[1].split()[5:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean = corpus_pipeline.clean_of_benchmark(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r.row for r in clean.collect()) == [0, 2, 3, 4, 5, 6]
    for stage in (corpus_pipeline.civil, corpus_pipeline.without_secrets):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 4


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from quarry.llm.common import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:1")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
