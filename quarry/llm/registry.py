"""The opN queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, blocks, decontaminate, html, licenses, oracles, packing, secrets, simhash, suffixes, toxicity
from quarry.llm.common import table


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_strings(table(spark, sf_dir, "documents"))
    n_removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.expr("array_join(transform(filter(spans, s -> s.kind IN ('assign', 'access', 'hex')), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    every = F.expr("array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def held_out():
    """True of the documents that learning must not see: the CRC-32 of their id leaves 1 modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.learn(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), payload=packing.crc32_of, payload_type=pa.int64())
    return packed.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.repeated_runs(table(spark, sf_dir, "documents"))
    n_removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


QUERIES = {"op1_ann": op1_ann, "op2_packing": op2_packing, "op3_licenses": op3_licenses, "op4_secrets": op4_secrets, "op10_toxicity": op10_toxicity, "op5_html": op5_html, "op6_suffix_dedup": op6_suffix_dedup, "op7_simhash": op7_simhash, "op8_blocks": op8_blocks, "op9_decontaminate": op9_decontaminate}
ORACLES = {"op3_licenses": oracles.op3(), "op9_decontaminate": oracles.OP9}
