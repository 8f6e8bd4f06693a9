"""Removal of every repeated run of `width` words, by fixed-block anchors.

The words of each document are cut into non-overlapping blocks of (width + 1) // 2, which are indexed; every rolling
window of that size probes the index. Any run of width words holds a whole block, so each repeat is hit. Hits are
extended to the windows of width words around them, which are compared by a hash of all their words; the union of
those that occur again is the maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quarry.llm import exchange
from quarry.llm.common import batches, checkpointed, keyed, mix, powers
from quarry.llm.exchange import BLOCK, MULTI, WHOLE
from quarry.llm.suffixes import _again, runs, settle

BATCH = 8 << 20
_BASE = 0xC2B2AE3D27D4EB4F


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def windows_of(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of size words inside a document."""
    lengths = np.diff(starts)
    counts = np.maximum(lengths - size + 1, 0)
    begin = np.cumsum(counts) - counts
    window = np.repeat(starts[:-1] - begin, counts) + np.arange(counts.sum())
    return window, hash_at(hashes, window, size)


def hash_at(hashes: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
    up, down = powers(_BASE, len(hashes) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
        return mix((prefix[window + size] - prefix[window]) * down[window])


def probe_requests(docs: list, shards: int, block: int) -> list[tuple]:
    """Every rolling window of block words, those on the fixed grid marked as blocks of the index.

    A window that the batch holds twice is a candidate at once; one entry then stands for all of its places.
    """
    words = [t.split() for _, t in docs]
    batch = exchange.Batch([d for d, _ in docs], [len(w) for w in words], shards)
    hashes = np.concatenate([word_hashes(w) for w in words])
    del words
    window, key = windows_of(hashes, batch.starts, block)
    if not len(window):
        return []
    grid = (window - batch.starts[np.searchsorted(batch.starts, window, side="right") - 1]) % block == 0
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    size = np.bincount(group)
    flag = np.where(size > 1, MULTI, 0) | np.where(np.logical_or.reduceat(grid[order], at), BLOCK, 0)
    sent = np.argsort(window[order[at]], kind="stable")
    first = order[at][sent]
    again = np.sort(window[order[size[group] > 1]])
    return [batch.directory(), *batch.asks(key[first], window[first], flag[sent], None, narrow=True), *batch.local(again, np.full(len(again), WHOLE))]


def _hit(state: np.ndarray) -> np.ndarray:
    return np.where((state & MULTI > 0) & (state & BLOCK > 0), WHOLE, 0)


def window_requests(docs: list, shards: int, width: int, block: int) -> list[tuple]:
    """The windows of width words that hold a hit, to be compared in full."""
    docs = [(d, t.split(), exchange.merged(d["first"])[0]) for d, t in docs]
    docs = [(d, w, p) for d, w, p in docs if len(w) >= width and len(p)]
    if not docs:
        return []
    batch = exchange.Batch([d for d, _, _ in docs], [len(w) for _, w, _ in docs], shards)
    hashes = np.concatenate([word_hashes(w) for _, w, _ in docs])
    spans = []
    for (_, w, p), s in zip(docs, batch.starts, strict=False):
        around = runs(np.maximum(p - (width - block), 0), np.minimum(p, len(w) - width) + 1)
        spans.append(around[around[:, 1] > around[:, 0]] + s)
    spans = np.concatenate(spans)
    counts = spans[:, 1] - spans[:, 0]
    window = np.repeat(spans[:, 0] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    window = np.unique(window)
    check = (hash_at(hashes ^ np.uint64(_BASE), window, width) >> np.uint64(32)).astype(np.uint32)
    return [batch.directory(), *settle(batch, hash_at(hashes, window, width), window, check)]


def repeated_runs(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (text), spans array<array<long>>, n_words of every row: spans are the maximal runs of words that
    some window of width words covers which starts anywhere else too; kept is the other words, joined by a space.

    Words are runs of other characters than ASCII white space. Null texts have none; texts under width words lose
    none; rows that repeat, whole or with their id, are documents of their own; a null id stays null; an empty table
    gives no row.
    """
    docs = keyed(docs, id_col, text_col)
    n, block = exchange.shards(docs), (width + 1) // 2
    size = exchange.batch_bytes(n, BATCH)

    def probes(stream):
        for held in batches(stream, size):
            yield exchange.tabled(probe_requests(held, n, block))

    first = checkpointed(exchange.ask(docs.mapInArrow(probes, exchange.REQUEST), np.uint8, True, _hit))
    told = exchange.joined(docs, first, "first")

    def extend(stream):
        for held in batches(stream, size):
            yield exchange.tabled(window_requests(held, n, width, block))

    second = exchange.ask(told.where("first IS NOT NULL").mapInArrow(extend, exchange.REQUEST), np.uint32, False, _again)
    both = exchange.joined(told.drop("first"), second, "second").select("doc_id", "text", "second")

    def cut(stream):
        for held in batches(stream, size):
            ids, kept, spans, sizes = [], [], [], []
            for row, data in held:
                words = data.split()
                at = exchange.merged(row["second"])[0]
                gone = runs(at, at + width)
                edges = [0, *gone.ravel().tolist(), len(words)]
                ids.append(row["doc_id"])
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]))
                spans.append(gone.tolist())
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "spans", "n_words"])

    return both.mapInArrow(cut, "doc_id long, kept string, spans array<array<long>>, n_words long")
