"""Helpers that the training-data operators share.

Null texts count as empty everywhere. An operator reads only the columns it names, so further columns of its
input, whatever they are called, never clash with its own.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator holds as one batch in a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that spark.checkpoint.dir names. Where it is unset a local session gets one of
    its own; on a cluster that is an error, since executors don't share a machine's temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder. Spark drops the files once the frame is out of use if
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows and table joined on key, however many rows a key has. table has a row for each key, whose column _n says how
    many of the total rows have it, which the result leaves out.

    Keys with over a share of 1 / (4 * partitions) of the rows, so at most 4 * partitions of them, are broadcast, and
    their rows stay where they are; the others are shuffled.
    """
    limit = total // (4 * partitions(rows.sparkSession))
    heavy, light = F.broadcast(table.where(F.col("_n") > limit).drop("_n")), table.where(F.col("_n") <= limit).drop("_n")
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key)
    return rows.join(heavy, key).unionByName(rest)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, text: h is a digest of the text, so rows that share an id stay apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty, without decoding them."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches(stream, size: int = BATCH_BYTES, text: str = "text"):
    """Regroups Arrow batches into lists of (row dict without the text, text bytes) of about size bytes."""
    held, total = [], 0
    for batch in stream:
        names = [n for n in batch.schema.names if n != text]
        others = [batch.column(n).to_pylist() for n in names]
        texts = as_bytes(batch.column(text))
        for i, data in enumerate(texts):
            held.append(({n: c[i] for n, c in zip(names, others, strict=True)}, data))
            total += len(data) + 64
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i below n."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), b, np.uint64), dtype=np.uint64))) for b in (base, inverse))
