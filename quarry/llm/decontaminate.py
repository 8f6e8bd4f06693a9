"""Benchmark decontamination: places of windows from shared shingles, exact similarity.

Only DataFrame functions. A document is contaminated by an item of n words if a window of n of its words has a
weighted similarity of `similarity` or more to it: over multisets of 5-word shingles, sum of least over sum of
greatest multiplicities. A document with fewer shingles than the item is one window, all of it. A window of w shingles
that is similar to an item of m shares s of them with s / (m + w - s) >= similarity, so the shingles common to both,
found by a join, name all places where a window can stand. How many count in each window follows from one sweep over the
places, so a document costs no more than its length, whatever it repeats. The join leaves out nothing similar, so no SimHash index stands beside it: it could find no
further window, and its radius drops similar ones (two words in turn, one shingle more of either, turn a fingerprint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keyed

#: Words are runs of letters and digits in lower case.
_WORDS = r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> '')"
WORDS = 5


def _grams(k: int) -> str:
    """The hashes of all runs of k words of column ws; no run gives an empty array."""
    parts = ", ".join(f"ws[i + {j}]" for j in range(k))
    return f"IF(size(ws) >= {k}, transform(sequence(0, size(ws) - {k}), i -> xxhash64({parts})), array())"


def _held(df: DataFrame, name: str, expression: str) -> DataFrame:
    """df with a column computed once a row: a generator, unlike a projection, is not copied into the lambdas that use it."""
    return df.withColumn(name, F.explode(F.expr(f"array({expression})")))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, broadcast_grams: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, h, item_id, similarity of each document (h is a digest of its text) and item that it holds: the best
    window's.

    Items of under five words have one shingle, all of their words; items without a word, and null items, match
    nothing, as do null and empty documents. Different texts of one item_id are all searched, and count as one item.
    Rows that share id and text count once; a null doc_id stays null. The shingles of the benchmark are broadcast only while they are at most broadcast_grams rows of 40 bytes, and shuffled
    beyond that. Empty tables give no row.
    """
    docs = keyed(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").withColumn("t", F.xxhash64("text")).dropDuplicates(["item_id", "t"])
    items = items.select("item_id", "t", F.expr(_WORDS).alias("ws")).where("size(ws) > 0")
    sizes = [f"WHEN {k} THEN {_grams(k)}" for k in range(1, WORDS + 1)]
    items = _held(items.withColumn("k", F.least(F.size("ws"), F.lit(WORDS))), "grams", f"CASE k {' '.join(sizes)} END")
    items = items.select("item_id", "t", "k", "grams", F.size("grams").alias("m"))
    grams = items.select("item_id", "t", "k", "m", F.explode("grams").alias("g")).groupBy("item_id", "t", "k", "m", "g").agg(F.count("*").alias("weight"))
    used = [r.k for r in items.select("k").distinct().collect()]  # at most five sizes
    small = F.broadcast if grams.limit(broadcast_grams + 1).count() <= broadcast_grams else (lambda df: df)

    words = docs.select("doc_id", "h", F.expr(_WORDS).alias("ws"))
    pieces = [words.select("doc_id", "h", F.lit(k).alias("k"), F.expr(f"size(ws) - {k - 1}").alias("n"), F.posexplode(F.expr(_grams(k))).alias("pos", "g")) for k in used]
    if not pieces:
        return docs.sparkSession.createDataFrame([], f"doc_id long, h long, item_id {benchmark.schema[item_col].dataType.simpleString()}, similarity double")
    every = pieces[0]
    for piece in pieces[1:]:
        every = every.unionByName(piece)
    shared = every.join(small(grams), ["k", "g"])
    by = ["doc_id", "h", "item_id", "t", "k", "m", "n"]
    # where each shared shingle stands in the document, once however often its row repeats
    held = shared.groupBy(*by, "g", "weight").agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    places = held.groupBy(*by).agg(F.sum(F.size("pos")).alias("shared"), F.collect_list(F.struct("weight", "pos")).alias("held"))
    places = places.withColumn("w", F.least("m", "n")).where(f"shared * {1 + similarity} >= {similarity} * (m + w)")

    # A shingle that the item holds weight times counts at p in the windows that start after its weight-th last place and
    # after p - w, up to p: an interval of starts. The best window is where most intervals meet.
    first = "greatest(p - w, IF(i >= x.weight, get(x.pos, i - cast(x.weight AS int)), -1), -1) + 1"
    ends = f"transform(x.pos, (p, i) -> array(struct({first} AS at, 1 AS turn), struct(least(p, n - w) + 1 AS at, -1 AS turn)))"
    turns = f"array_sort(flatten(flatten(transform(held, x -> {ends}))))"
    open_ = "aggregate(turns, struct(0 AS open, 0 AS most), (s, e) -> struct(s.open + e.turn AS open, greatest(s.most, s.open + e.turn) AS most), s -> s.most)"
    counted = _held(_held(places, "turns", turns), "s", open_).where(f"s * {1 + similarity} >= {similarity} * (m + w)")
    return counted.withColumn("similarity", F.expr("s / (m + w - s)")).groupBy("doc_id", "h", "item_id").agg(F.max("similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, **how) -> DataFrame:
    """doc_id, item_id, similarity of each document and item that it holds: the best window's. See leaks."""
    return leaks(docs, benchmark, similarity, **how).drop("h")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, whose id and text hold no item."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("i"), "h").distinct()
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), digest.alias("digest"), F.struct("*").alias("row"))
    return rows.join(found, rows.doc.eqNullSafe(found.i) & (rows.digest == found.h), "left_anti").select("row.*")
