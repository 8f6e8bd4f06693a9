"""Removal of every repeated string of `width` bytes, by a logarithmic family of sparse suffix arrays.

A dense suffix array takes eight bytes for each byte of text. Here the arrays hold the suffixes at synchronising
positions only: the leftmost least of the hashed `seed_bytes`-grams of each window of `width` bytes. Equal windows
choose the same position, so a repeat is found from the suffixes that begin alike. Each batch of documents gets its
sorted array; shards of the index merge-scan it against their levels, and levels of like size merge
(`exchange.Family`). A suffix is stored by the hash of its first bytes, with the hash of the bytes around it.

* A suffix met once settles its windows: none is repeated.
* If all suffixes that begin alike stand in the same surroundings (every window that chose them lies inside), all
  those windows are repeated.
* Otherwise the windows that chose them are compared one by one, in the same way, by the hash of all their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import exchange
from quarry.llm.common import batches, checkpointed, keyed, mix, powers
from quarry.llm.exchange import MIXED, MULTI, WHOLE, WINDOWS

BATCH = 4 << 20
#: Bits of a place in a batch, the same for every batch, so that equal windows compare the same bits of hashes: a batch
#: is closed by the text that passes its size, and no text reaches 2 GiB.
_PLACE = 32
_BASE, _OTHER = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Strings:
    """Hashes of the strings of one buffer, by a base."""

    def __init__(self, data: bytes, base: int = _BASE):
        n = len(data)
        up, self.down = powers(base, n + 1)
        with np.errstate(over="ignore"):
            terms = _BYTES[np.frombuffer(data, np.uint8)] * up[:n]
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def rolling(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[size:] - self.prefix[:-size]) * self.down[: len(self.prefix) - size])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[stop] - self.prefix[start]) * self.down[start])


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values, by doubling."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def anchors(strings: Strings, starts: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows inside documents: the positions chosen, the hash of the bytes there, the first and last window
    that chose each, and the document of each."""
    n = int(starts[-1])
    none = (np.empty(0, np.int64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if n < width:
        return none
    grams = strings.rolling(seed)
    low = np.uint64((1 << _PLACE) - 1)
    chosen = (_sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - seed + 1) & low).astype(np.int64)
    lengths = np.diff(starts)
    whole = np.flatnonzero(lengths >= width)
    if not len(whole):
        return none
    counts = lengths[whole] - width + 1
    window = np.repeat(starts[whole] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    doc = np.repeat(whole, counts)
    at = chosen[window]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(new[1:], len(at)) - 1
    return at[new], grams[at[new]], window[new], window[last], doc[new]


def _surroundings(strings: Strings, at, doc, starts, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.maximum(at - (width - seed), starts[doc]), np.minimum(at + width, starts[doc + 1])
    with np.errstate(over="ignore"):
        around = mix(strings.at(low, high) ^ ((at - low).astype(np.uint64) << np.uint64(32)) ^ (high - at).astype(np.uint64))
    return around, low, high


def first_requests(docs: list, shards: int, width: int, seed: int) -> list[tuple]:
    """The suffix array of a batch, as requests: what the batch can settle itself, and one entry for each beginning."""
    texts = [t for _, t in docs]
    batch = exchange.Batch([d for d, _ in docs], [len(t) for t in texts], shards)
    strings = Strings(b"".join(texts))
    at, key, _, _, doc = anchors(strings, batch.starts, width, seed)
    if not len(at):
        return []
    around, _, _ = _surroundings(strings, at, doc, batch.starts, width, seed)
    order = np.lexsort((around, key))
    k, a = key[order], around[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_pair = new_key | np.concatenate(([True], a[1:] != a[:-1]))
    key_of, pair_of = np.cumsum(new_key) - 1, np.cumsum(new_pair) - 1
    pairs = np.bincount(key_of[new_pair])  # different surroundings of each key
    size = np.bincount(pair_of)  # places of each pair
    status = np.where(size[pair_of] > 1, WHOLE, 0) | np.where((pairs[key_of] > 1) & new_pair, WINDOWS, 0)
    flag = np.where(np.bincount(key_of) > 1, MULTI, 0) | np.where(pairs > 1, MIXED, 0)
    first = np.flatnonzero(new_key)
    sent = np.argsort(at[order[first]], kind="stable")
    rows = [batch.directory()]
    rows += batch.asks(k[first][sent], at[order[first]][sent], flag[sent], a[first][sent], narrow=False)
    held = np.flatnonzero(status)
    back = np.argsort(at[order[held]], kind="stable")
    return rows + batch.local(at[order[held]][back], status[held][back])


def second_requests(docs: list, shards: int, width: int, seed: int) -> list[tuple]:
    """The windows to be told apart in a batch: those of suffixes that stand in several surroundings."""
    docs = [(d, t, pos[status & WINDOWS > 0]) for d, t in docs for pos, status in [exchange.merged(d["first"])]]
    docs = [(d, t, p) for d, t, p in docs if len(p)]
    if not docs:
        return []
    batch = exchange.Batch([d for d, _, _ in docs], [len(t) for _, t, _ in docs], shards)
    data = b"".join(t for _, t, _ in docs)
    strings = Strings(data)
    at, _, first, last, _ = anchors(strings, batch.starts, width, seed)
    wanted = np.concatenate([p + s for (_, _, p), s in zip(docs, batch.starts, strict=False)])
    keep = np.isin(at, wanted)
    first, counts = first[keep], (last - first + 1)[keep]
    window = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    key = strings.at(window, window + width)
    del strings
    check = (Strings(data, _OTHER).at(window, window + width) >> np.uint64(32)).astype(np.uint32)
    return [batch.directory(), *settle(batch, key, window, check)]


def settle(batch: exchange.Batch, key: np.ndarray, place: np.ndarray, check: np.ndarray) -> list[tuple]:
    """Requests for windows: those that the batch repeats are answered here and sent once, the others ask."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(k) else np.empty(0, np.int64)
    first = order[np.flatnonzero(new)]
    sent = np.argsort(place[first], kind="stable")
    at = first[sent]
    flag = np.where(size > 1, MULTI, 0)[sent] if len(k) else np.empty(0, np.int64)
    again = np.sort(place[order[size[group] > 1]]) if len(k) else np.empty(0, np.int64)
    return [*batch.asks(key[at], place[at], flag, check[at], narrow=False), *batch.local(again, np.full(len(again), WHOLE))]


def _first_status(state: np.ndarray) -> np.ndarray:
    return np.where(state & MULTI == 0, 0, np.where(state & MIXED > 0, WINDOWS, WHOLE))


def _again(state: np.ndarray) -> np.ndarray:
    return np.where((state & MULTI > 0) & (state & MIXED == 0), WHOLE, 0)


def removed(data: bytes, first: list | None, second: list | None, width: int, seed: int) -> np.ndarray:
    """The bytes to remove, as runs (start, stop) that rise and do not touch."""
    pos, status = exchange.merged(first)
    pos = pos[status & WHOLE > 0]
    windows, _ = exchange.merged(second)
    starts = np.concatenate((np.maximum(pos - (width - seed), 0), windows))
    stops = np.concatenate((np.minimum(pos + width, len(data)), windows + width))
    return runs(starts, stops)


def runs(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The union of intervals."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return np.stack((starts[new], reach[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]), axis=1)


def repeated_strings(docs: DataFrame, width: int = 200, seed_bytes: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (bytes), spans array<array<long>>, n_bytes of every row: spans are the maximal runs of bytes that
    some string of width bytes covers which starts anywhere else too; kept is the rest.

    Null texts are empty; texts under width bytes have no such string; rows that repeat, whole or with their id,
    are documents of their own. A null id stays null. An empty table gives no row.
    """
    docs = keyed(docs, id_col, text_col)
    n = exchange.shards(docs)
    size = exchange.batch_bytes(n, BATCH)

    def suffix_arrays(stream):
        for held in batches(stream, size):
            yield exchange.tabled(first_requests(held, n, width, seed_bytes))

    first = checkpointed(exchange.ask(docs.mapInArrow(suffix_arrays, exchange.REQUEST), np.uint64, False, _first_status))
    told = exchange.joined(docs, first, "first")

    def windows(stream):
        for held in batches(stream, size):
            yield exchange.tabled(second_requests(held, n, width, seed_bytes))

    second = exchange.ask(told.where("first IS NOT NULL").mapInArrow(windows, exchange.REQUEST), np.uint32, False, _again)
    both = exchange.joined(told, second, "second").select("doc_id", "text", "first", "second")

    def cut(stream):
        for held in batches(stream, size):
            ids, kept, spans, sizes = [], [], [], []
            for row, data in held:
                gone = removed(data, row["first"], row["second"], width, seed_bytes)
                edges = [0, *gone.ravel().tolist(), len(data)]
                ids.append(row["doc_id"])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append(gone.tolist())
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "spans", "n_bytes"])

    return both.mapInArrow(cut, "doc_id long, kept binary, spans array<array<long>>, n_bytes long")
