from quarry.plans import index
from quarry.plans.search import SearchOptions, resolve_mode, search, search_one
from quarry.streaming import watch

SCHEMA = watch.SCHEMA
TOPICS = {"retry": "retry the request with backoff\nafter a timeout", "auth": "login checks the password hash\nand the session token", "cache": "evict the oldest cache entry\nwhen the budget is spent", "parse": "parse the header and the body\nof each message"}


def files(spark, **change):
    rows = [(f"src/{k}.txt", len(v), 1, v) for k, v in {**TOPICS, **change}.items() if v is not None]
    return spark.createDataFrame(rows, SCHEMA)


def shape(df):
    return [(r.query_id, r.rank, r.path, r.start_line, round(r.score, 6)) for r in df.orderBy("query_id", "rank").collect()]


def ask(spark):
    return spark.createDataFrame([(1, "retry timeout|session token")], "query_id long, raw string")


def test_persisted_equals_computed_and_repaired_equals_rebuilt(spark, tmp_path):
    options = SearchOptions(mode="hybrid", k=3)
    path = str(tmp_path / "idx")
    index.build(files(spark), options, path)
    cold = shape(search(files(spark), ask(spark), options))
    warm, how = index.search_index(spark, path, files(spark), ask(spark), options)
    assert how == "warm" and shape(warm) == cold
    live = files(spark, auth=None, cache="retry the session token\nnow longer text", extra="a new timeout file")
    tables, how = index.repaired(spark, path, live, options, max_drift=1.0)
    from quarry.plans.search import search_tables

    fixed = shape(search_tables(tables, ask(spark), options))
    assert how == "repaired" and fixed == shape(search(live, ask(spark), options))
    assert all("auth" not in p for _, _, p, _, _ in fixed)
    assert index.repaired(spark, path, live, options)[1] == "drift too large"
    from dataclasses import replace

    from quarry.operators.chunking import ChunkParams

    assert index.load(spark, path, replace(options, chunk=ChunkParams(window=16))) is None
    assert index.load(spark, str(tmp_path / "none"), options) is None
    assert [r.dead for r in index.registry(spark, str(tmp_path)).collect()] == [False]


def test_eviction_spares_what_is_not_an_index(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("retry")
    options = SearchOptions(mode="bm25")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    index.build(files(spark), options, one, str(root))
    index.build(files(spark), options, two)
    flight = tmp_path / ("three.building-" + "0" * 32)
    flight.mkdir()
    (flight / "x").write_text("y")
    assert index.enforce_budget(spark, one) == [] and index.enforce_budget(spark, str(tmp_path)) == []
    assert index.load(spark, one, options) is not None and (root / "a.txt").exists() and flight.exists()
    # over budget: the older of two goes, a protected one stays, and the source and the build in flight stay too
    assert [p.rpartition("/")[2] for p in index.enforce_budget(spark, str(tmp_path), 1, keep=two)] == ["one"]
    assert (root / "a.txt").exists() and flight.exists() and index.load(spark, two, options) is not None
    assert [p.rpartition("/")[2] for p in index.enforce_budget(spark, str(tmp_path), 1 << 40, abandoned=0)] == [flight.name]
    index.build(files(spark), options, one, str(tmp_path / "gone"))
    assert [p.rpartition("/")[2] for p in index.enforce_budget(spark, str(tmp_path))] == ["one"]  # its corpus is gone
    assert [p.rpartition("/")[2] for p in index.clear(spark, str(tmp_path))] == ["two"] and (root / "a.txt").exists()


def test_upkeep_of_indexes(spark, tmp_path):
    root, inner = tmp_path / "tree", tmp_path / "tree" / "src"
    inner.mkdir(parents=True)
    options, cache = SearchOptions(mode="bm25"), tmp_path / "cache"
    wide, narrow, old = (str(cache / n) for n in ("wide", "narrow", "old"))
    for path, of in ((wide, root), (narrow, inner), (old, root)):
        index.build(files(spark), options, path, str(of))
    index.build(files(spark), options, str(root / ".quarry"), str(root))
    (root / ".git" / ".quarry").mkdir(parents=True)
    assert index.in_tree(spark, str(tmp_path / "tree")) == [f"file:{root}/.quarry"]
    assert [p.rpartition("/")[2] for p in index.promote(spark, str(cache), wide)] == ["narrow"]
    meta = next((cache / "old" / "meta").glob("part-*"))
    meta.write_text(meta.read_text().replace(index.GENERATION, "other"))
    (meta.parent / f".{meta.name}.crc").unlink()
    assert index.load(spark, old, options) is None
    assert [p.rpartition("/")[2] for p in index.prune(spark, str(cache))] == ["old"]
    assert not index.validated(spark, wide) and index.repaired(spark, wide, files(spark), options)[1] == "no drift" and index.validated(spark, wide)
    assert index.repaired(spark, wide, files(spark, auth=None), options, 1.0, ttl=60)[1] == "no drift"
    assert index.repaired(spark, wide, files(spark, auth=None), options, 1.0)[1] == "repaired"
    import shutil

    shutil.rmtree(cache / "wide" / "postings")
    found, how = index.search_index(spark, wide, files(spark), ask(spark), options)
    assert how == "cold" and found.count() > 0 and not index.exists(spark, wide)


def test_weights_survive_an_index(spark, tmp_path):
    options = SearchOptions(mode="hybrid", k=3, sif=True, sif_center=True, maxsim=True, maxsim_post=True, prf=2, bridge=2)
    path = str(tmp_path / "idx")
    index.build(files(spark), options, path)
    warm, how = index.search_index(spark, path, files(spark), ask(spark), options)
    assert how == "warm" and shape(warm) == shape(search(files(spark), ask(spark), options))
    from dataclasses import replace

    assert index.load(spark, path, replace(options, sif_idf=True)) is None


def test_filters_after_ranking_still_fill_k(spark):
    many = {f"f{i:02d}": "\n".join(["blank"] * (i % 2)) + "\nretry it" for i in range(30)}
    found = search_one(spark, files(spark, **many), "retry", SearchOptions(mode="bm25", k=5, lines=(2, 2)))
    assert [r.rank for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5] and {r.line for r in found.collect()} == {2}
    from quarry.plans.search import suggestion, tables

    t = tables(files(spark), SearchOptions())
    assert suggestion(files(spark), "retrying(", t).count() == 3 and suggestion(files(spark), "retrying(").count() == 0
    assert SearchOptions(file_window=8).for_file().chunk.window == 8 and SearchOptions().for_file() == SearchOptions()


def test_stream_keeps_an_index(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "idx")
    options = SearchOptions(mode="bm25", k=2)
    files(spark).write.parquet(source)
    watch.watch(spark, source, path, str(tmp_path / "cp"), options, once=True).awaitTermination()
    spark.createDataFrame([("src/retry.txt", 5, 2, "nothing here"), ("src/auth.txt", 0, 2, None)], SCHEMA).write.mode("append").parquet(source)
    watch.watch(spark, source, path, str(tmp_path / "cp"), options, once=True).awaitTermination()
    assert sorted((r.path, r.mtime) for r in index.files_of(spark, path).collect()) == [("src/cache.txt", 1), ("src/parse.txt", 1), ("src/retry.txt", 2)]


def test_scope_and_modes(spark):
    found = search_one(spark, files(spark, **{"deep/one": "retry retry", "deep/two": "retry again"}), "retry", SearchOptions(mode="bm25", k=2, prefix="src/deep"))
    assert sorted(r.path for r in found.collect()) == ["src/deep/one.txt", "src/deep/two.txt"]
    assert resolve_mode(True, "bm25")[0] == "keyword" and resolve_mode(False, None)[0] == "semantic"
    exact = search_one(spark, files(spark), "the (old|ses)", SearchOptions(mode="keyword"))
    assert sorted((r.path, r.line) for r in exact.collect()) == [("src/auth.txt", 2), ("src/cache.txt", 1)]
