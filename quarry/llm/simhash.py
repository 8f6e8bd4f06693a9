"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r // 2 of each (the middle of the path between them). The
plain ball of a 64-bit fingerprint at r = 4 has 2,081 variants. Cutting the bits into three blocks first is exact
and cheaper: of the three pairs of blocks, one holds at most two thirds of the differing bits, so at most 2 of 4;
its ball of half that radius has 43 variants. `blocks=1` gives the plain ball.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, checkpointed, keyed, partitions, spread_join
from quarry.llm.components import components

_CHUNK = 1 << 15


def fingerprint(data: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: ASCII lower case, shingles of words, repeats included; 0 if it has no word."""
    found = data.lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(joined, seed)
    ends = list(accumulate(map(len, found), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    n, ones = len(found) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        h = np.array([digest(joined[p:q], seed) for p, q in zip(starts[at:stop], ends[at + words - 1 : stop + words - 1], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(fp: int) -> int:
    """The same 64 bits as a signed long."""
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, fp (the 64 bits as a signed long) of every row; h is a digest of the text. Null and blank texts have
    fingerprint 0."""

    def run(stream):
        for batch in stream:
            fps = np.array([fingerprint(x, words, seed) for x in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, h long, fp long")


def _spread(bits: int, blocks: int, radius: int) -> list[tuple[int, np.ndarray]]:
    """(bits kept, the flips that a fingerprint emits) for each choice of blocks."""
    if blocks == 1:
        kept, radii = [range(bits)], radius // 2 + radius % 2
        groups = [(0, k) for k in kept]
    else:
        edges = [bits * i // blocks for i in range(blocks + 1)]
        parts = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        groups = [(sum(1 << i for i in range(bits) if i in parts[out]) , [i for k in range(blocks) if k != out for i in parts[k]]) for out in range(blocks)]
        within = radius * (blocks - 1) // blocks
        radii = within // 2 + within % 2
    spread = []
    for free, kept in groups:
        flips = [sum(1 << i for i in c) for r in range(radii + 1) for c in combinations(kept, r)]
        spread.append((free, np.array(flips, np.uint64)))
    return spread


def _links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(index, root's index) for each value that links join to an earlier one; values are distinct.

    A search that visits each value once, each time against the values not yet reached: no list of pairs.
    """
    rest, out = np.arange(len(values)), []
    while len(rest):
        root, rest, front = rest[0], rest[1:], [rest[0]]
        while front and len(rest):
            near = np.bitwise_count(values[rest] ^ values[front.pop()]) <= radius
            reached, rest = rest[near], rest[~near]
            front.extend(reached)
            out.extend((i, root) for i in reached)
    return out


def links(fps: DataFrame, radius: int = 4, blocks: int = 3) -> DataFrame:
    """a, b: links that join the same fingerprints as all pairs within radius do. fps: column fp, taken distinct.

    Each bucket is one variant; its members are verified against each other in bounded blocks, and it gives a
    spanning forest rather than its pairs. Equal fingerprints have met before, so a bucket holds distinct ones.
    """
    spread = _spread(64, blocks, radius)

    def emit(stream):
        for batch in stream:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                fp = all_fps[at : at + 2048]
                for k, (free, flips) in enumerate(spread):
                    low = np.uint64(free & -free) if free else np.uint64(0)
                    tag = np.uint64(k + 1) * low if free else np.uint64(0)
                    key = ((fp & np.uint64(~free & (1 << 64) - 1)) | tag)[:, None] ^ flips[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["key", "fp"])

    def scan(stream):
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(key, fp):
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            a, b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                group = np.unique(fp[starts[i] : ends[i]])
                for x, y in _links(group.view(np.uint64), radius):
                    a.append(group[x])
                    b.append(group[y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in stream:
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False)))
            last = np.searchsorted(key, key[-1]) if len(key) else 0  # the last bucket may go on
            if last:
                yield found(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield found(key, fp)

    n = partitions(fps.sparkSession)
    # one fingerprint becomes many rows: deal them out first, however few bytes they are
    variants = fps.select("fp").distinct().repartition(n).mapInArrow(emit, "key long, fp long")
    return variants.repartition(n, "key").sortWithinPartitions("key").mapInArrow(scan, "a long, b long").distinct()


def groups(docs: DataFrame, radius: int = 4, blocks: int = 3, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, fp, root, component_id of every row: root names its group, even where ids repeat or are null."""
    prints = checkpointed(fingerprints(docs, words, seed, id_col, text_col))
    first = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n")))
    n = first.agg(F.count("*").alias("fps"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    roots = components(links(first.select("fp"), radius, blocks))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpointed(rooted.select("fp", "first_id", "root", F.col("_n").alias("rows")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_n"))
    named = spread_join(rooted, least, "root", n.fps).select("fp", "root", "component_id", F.col("rows").alias("_n"))
    return spread_join(prints, named, "fp", n.rows).select("doc_id", "h", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, blocks: int = 3, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of at most radius bits reach.

    A null doc_id is a row like any other but never names a component unless no other id is there (then null).
    Repeated rows come back as often as they came. An empty table gives no row.
    """
    return groups(docs, radius, blocks, words, seed, id_col, text_col).select("doc_id", "fp", "component_id")


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the least id, null ids last; of rows that share
    it, the least digest of the text, then the least row. Ids may repeat and columns may have any name."""
    found = groups(docs, id_col=id_col, text_col=text_col, **how)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("head")
    heads = found.groupBy("root").agg(head).select(F.col("head.doc_id").alias("i"), F.col("head.h").alias("h"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"), F.struct("*").alias("row"))
    kept = rows.join(heads, rows.doc.eqNullSafe(heads.i) & (rows.digest == heads.h), "left_semi")
    return kept.groupBy("doc", "digest").agg(F.min("row").alias("row")).select("row.*")
