"""Packing of token sequences as a cutting-stock problem solved by column generation.

Documents are cut into whole sequences and one remainder. The histogram of piece lengths, at most `capacity` numbers,
goes to the driver. There a linear program over patterns (how many pieces of each length share a sequence) is solved:
dynamic programming over the knapsack prices new patterns, and a revised simplex takes them in. Patterns are rounded
down, what is left is packed first-fit, and the executors deal the patterns out to the ranked pieces. The program
works on classes of lengths, each rounded up to a multiple of `width`; offsets count true lengths.
"""

from __future__ import annotations

import base64
import functools
import warnings
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, partitions

#: Id that ends each document.
END_ID = 0


@functools.cache
def encoder(path: str):
    """A byte-level BPE read from a rank file; special tokens in a text keep their own id, as the JSON form has it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ids_of(text: str, path: str) -> np.ndarray:
    return np.append(np.array(encoder(path).encode(text, allowed_special="all"), np.uint32), np.uint32(END_ID))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the worth of the best pattern and its count of each length (lengths rising)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if k:
            worth = best[c - lengths[:k]] + value[:k]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], took[c] = worth[i], i
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), counts


def first_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns, one for each sequence, that hold all counts: the longest pieces first, into the first that fits."""
    bins: list[np.ndarray] = []
    room = np.empty(0, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        for _ in range(int(counts[i])):
            fits = np.flatnonzero(room >= lengths[i])
            if not len(fits):
                bins.append(np.zeros(len(lengths), np.int64))
                room = np.append(room, capacity)
                fits = [len(bins) - 1]
            bins[fits[0]][i] += 1
            room[fits[0]] -= lengths[i]
    return bins


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 2000) -> list[tuple[int, np.ndarray]]:
    """(sequences, pattern) pairs that hold every piece: min sum x over A x = counts, rounded.

    Ends when the value is within gap of Farley's bound (value over the price of the best pattern), or, with a warning,
    after rounds exchanges: the plan then holds every piece too, with more padding. Rounding down leaves less than one
    sequence for each pattern in the basis, packed first-fit.
    """
    m = len(lengths)
    if not m:
        return []
    fill = capacity // lengths
    columns = [np.where(np.arange(m) == i, fill[i], 0) for i in range(m)]
    inverse, x = np.diag(1 / fill), counts / fill
    bound = 0.0
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        worth, pattern = price(np.maximum(duals, 0), lengths, capacity)
        bound = max(bound, x.sum() / worth)
        if worth <= 1 + 1e-9 or x.sum() - bound <= gap * bound:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        move = max(ratio[out], 0.0)
        x -= move * step
        x[out] = move
        x[x < 0] = 0
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out] = pattern
    else:
        warnings.warn(f"packing: {x.sum():.0f} sequences, at least {bound:.0f}, after {rounds} exchanges", stacklevel=2)
    left, plan = counts.copy(), []
    for n, pattern in sorted(((int(v + 1e-7), tuple(p)) for v, p in zip(x, columns, strict=True)), reverse=True):
        use = np.array(pattern)
        held = use > 0
        n = min(n, int((left[held] // use[held]).min())) if held.any() else 0
        if n:
            plan.append((n, use))
            left -= n * use
    return plan + [(1, p) for p in first_fit(lengths, left, capacity)]


@dataclass(frozen=True)
class Deal:
    """Where the piece of a class and rank goes: rising rank bounds of each class, and their slots."""

    starts: dict[int, np.ndarray]
    slots: dict[int, np.ndarray]  # rows: first sequence, pieces a sequence, place of the first

    def __call__(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        for value in np.unique(kind):
            at = np.flatnonzero(kind == value)
            i = np.searchsorted(self.starts[value], rank[at], side="right") - 1
            first, each, begin = self.slots[value][i].T
            k = rank[at] - self.starts[value][i]
            sequence[at], slot[at] = first + k // each, begin + k % each
        return sequence, slot


def deal(plan: list[tuple[int, np.ndarray]], classes: np.ndarray) -> Deal:
    """Numbers the sequences of a plan and hands the ranks of each class out to them, longest pieces foremost."""
    starts: dict[int, list] = {int(v): [] for v in classes}
    slots: dict[int, list] = {int(v): [] for v in classes}
    given, sequence = dict.fromkeys(starts, 0), 0
    for n, pattern in plan:
        place = 0
        for i in np.flatnonzero(pattern)[::-1]:
            v, each = int(classes[i]), int(pattern[i])
            starts[v].append(given[v])
            slots[v].append((sequence, each, place))
            given[v] += n * each
            place += each
        sequence += n
    return Deal({k: np.array(v, np.int64) for k, v in starts.items()}, {k: np.array(v, np.int64).reshape(-1, 3) for k, v in slots.items()})


def cut(docs: DataFrame, capacity: int, path: str, payload: Callable[[np.ndarray], object], payload_type: pa.DataType, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, payload, doc_tokens: every document in whole sequences and one remainder."""

    def run(stream):
        for batch in stream:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows: list[tuple] = []

            def flush():
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), payload_type, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "payload", "doc_tokens"])

            for i in range(len(ids)):
                tokens = ids_of(texts[i].as_py() or "", path)
                for at in range(0, len(tokens), capacity):
                    piece = tokens[at : at + capacity]
                    rows.append((ids[i].as_py(), at, len(piece), payload(piece), len(tokens)))
                if len(rows) >= 4096:
                    yield flush()
                    rows.clear()
            yield flush()

    kind = "long" if pa.types.is_integer(payload_type) else "array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, start long, length long, payload {kind}, doc_tokens long")


def pack(docs: DataFrame, capacity: int = 1024, width: int = 8, path: str | None = None, payload: Callable[[np.ndarray], object] = lambda ids: ids.tolist(), payload_type: pa.DataType | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, payload, doc_tokens, sequence_id, offset of each piece.

    capacity is a multiple of width. payload turns the ids of a piece into what the row carries: the ids themselves unless given. Null and empty texts
    are the end id alone; repeated rows are packed as often as they come; a null id stays null; an empty table gives
    no piece. Pieces lie without gaps from offset 0, so only the end of a sequence is padded.
    """
    payload_type = payload_type or pa.list_(pa.int64())
    pieces = checkpointed(cut(docs, capacity, path or default_vocabulary(), payload, payload_type, id_col, text_col))
    pieces = pieces.withColumn("kind", F.ceil(F.col("length") / F.lit(width)).cast("long"))
    found = sorted((r.kind, r["count"]) for r in pieces.groupBy("kind").count().collect())  # at most capacity / width rows
    kinds, counts = np.array([k for k, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    handed = deal(solve(kinds, counts, capacity // width), kinds)

    # the rank of a piece in its class: its place in its bucket, after what lower buckets hold
    buckets = 4 * partitions(docs.sparkSession)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "payload"), F.lit(buckets)).cast("int"))
    lower = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("kind", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(lower), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "doc_tokens")) - 1
    ranked = bucketed.withColumn("place", place).join(before.select("kind", "bucket", "base"), ["kind", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "payload", "doc_tokens", "kind", (F.col("base") + F.col("place")).alias("rank"))

    def run(stream):
        for batch in stream:
            kind, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "rank"))
            sequence, slot = handed(kind, rank)
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "payload", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "payload", "doc_tokens", "sequence_id", "slot"])

    kind = dict(pieces.dtypes)["payload"].replace("bigint", "long")
    placed = ranked.mapInArrow(run, f"doc_id long, start long, length long, payload {kind}, doc_tokens long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` pieces
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")
