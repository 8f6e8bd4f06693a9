"""A training-data pipeline over documents: five stages, each a DataFrame of what the one before kept.

Every stage but the last returns the columns of documents. run() writes each stage's rows to the shared folder and
reads them back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, packing, secrets, simhash, toxicity
from quarry.llm.common import delete, shared_folder, table
from quarry.llm.registry import toxicity_model

#: The toxicity stage's trees are a trained model, which SQL can't express.
ORACLE_SQL = None


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.7 or more for toxicity."""
    return toxicity.keep_civil(docs, toxicity_model(spark, docs, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that with the least id."""
    return simhash.distinct(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose text holds a benchmark item; others that share their id stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET] and counts the characters again."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of at most 1,024 tokens."""
    pieces = packing.pack(docs, payload=packing.crc32_of, payload_type=pa.int64())
    return pieces.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", civil), ("near_duplicates", distinct), ("decontamination", clean_of_benchmark), ("secrets", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder goes once the next one is written, the last stays: it is the result."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
