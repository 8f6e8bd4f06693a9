"""Watching a corpus: files that arrive on a stream are taken into an index, batch by batch.

An extension of read-repair. Each micro-batch upserts its files by path and replaces the index as one publish, so a
batch that runs again after a failure leaves the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.plans import index
from quarry.plans.search import SearchOptions

SCHEMA = "path string, size long, mtime long, text string"


def upsert(spark: SparkSession, path: str, batch: DataFrame, options: SearchOptions) -> None:
    """The batch's newest version of each file over the indexed ones; a null text deletes."""
    newest = batch.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size")))).where("_n = 1").drop("_n")
    newest = newest.select("path", "size", "mtime", "text")
    if index.meta(spark, path) is not None:
        base = index.files_of(spark, path)
        stale = newest.join(base.select("path", F.col("mtime").alias("_m")), "path").where("mtime < _m").select("path")
        newest = newest.join(stale, "path", "left_anti")
        newest = base.join(newest, "path", "left_anti").unionByName(newest)
    index.build(newest.where("text IS NOT NULL"), options, path)


def watch(spark: SparkSession, source: str, path: str, checkpoint: str, options: SearchOptions = SearchOptions(), once: bool = False) -> StreamingQuery:
    """A query that reads Parquet files of SCHEMA from source and keeps the index at path up to date."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, _: upsert(batch.sparkSession, path, batch, options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def file_counts(spark: SparkSession, source: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """A stream of how many files changed in each window of event time, late ones dropped after the watermark."""
    stream = spark.readStream.schema(SCHEMA).parquet(source).withColumn("ts", F.timestamp_seconds("mtime"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
