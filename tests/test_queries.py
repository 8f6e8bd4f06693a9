"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
QUICK = ["walk_files", "glob_filter", "lines_of_document", "exact_regex", "exact_word", "exact_totals", "exact_context_blocks", "chunk_windows", "tokenize_code_aware", "split_camel", "term_freq", "bm25_scoped", "vector_normalize_quantize", "i8_topk_scoped", "learned_relevance", "diff_added_modified_deleted", "lru_evict", "index_discovery", "leakage_profile", "grep_baseline", "query_manifest", "chunk_budget", "span_dedupe", "mmr_select", "score_floor", "search_plain_phrases", "warm_bm25", "index_upkeep", "text_sniff", "walk_ignored", "word_ranges", "prose_tiers", "trace_validation", "tiered_replay", "result_rollup", "blind_recut", "oracle_grep", "query_validation", "where_stratify", "human_bytes"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "supplier", "customer", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df, columns):
    def one(v):
        if not hasattr(v, "__len__"):
            return "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
        return v if isinstance(v, str) else str([str(x) for x in v])

    return sorted(tuple(one(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry_runs(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
