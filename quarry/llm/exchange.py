"""Asking a sharded index, from batches of documents, which of their keys occur again anywhere.

A map task turns each batch into one row for each shard: binary columns of sorted keys with the places that ask. A
key that a batch holds several times is settled there and sent once, so no shard gets more than one entry of a key
from a batch, however common the key. Shards answer by place; answers meet the batch's directory and come back as
one row for each document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions

DIRECTORY, LOCAL, ASK = 0, 1, 2
#: Entry flags: it stands for several places; its places have different contexts; it stands on an aligned block.
MULTI, MIXED, BLOCK = 1, 2, 4
#: Answers: the key's whole context occurs again; its windows must be told apart one by one.
WHOLE, WINDOWS = 1, 2

REQUEST = "shard int, uid long, kind int, a binary, b binary, c binary, d binary"
ANSWER = "uid long, kind int, a binary, b binary, c binary, d binary"
FOUND = "doc_id long, h long, pos binary, status binary"


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def gaps(pos: np.ndarray) -> bytes:
    return squeeze(np.diff(pos, prepend=0).astype(np.uint32))


def places(data: bytes) -> np.ndarray:
    return expand(data, np.uint32).cumsum(dtype=np.int64)


class Batch:
    """The documents of one batch: their keys, and where each starts in the batch's own numbering of places."""

    def __init__(self, docs: list, sizes: list[int], shards: int):
        self.ids = np.array([np.iinfo(np.int64).min if d["doc_id"] is None else d["doc_id"] for d in docs], np.int64)
        self.h = np.array([d["h"] for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.uid = xxhash.xxh64_intdigest(self.ids.tobytes() + self.h.tobytes()) >> 1
        self.shards = shards

    def row(self, kind: int, a=b"", b=b"", c=b"", d=b"", shard: int | None = None) -> tuple:
        return (self.uid % self.shards if shard is None else shard, self.uid, kind, a, b, c, d)

    def directory(self) -> tuple:
        return self.row(DIRECTORY, squeeze(self.ids), squeeze(self.h), squeeze(self.starts))

    def local(self, pos: np.ndarray, status: np.ndarray) -> list[tuple]:
        return [self.row(LOCAL, d=gaps(pos), c=squeeze(status.astype(np.uint8)))] if len(pos) else []

    def asks(self, key: np.ndarray, pos: np.ndarray, flag: np.ndarray, aux: np.ndarray | None, narrow: bool) -> list[tuple]:
        """One row for each shard that keys fall to; pos rises. narrow keeps 32 bits of the keys beside the shard."""
        shard = (key % np.uint64(self.shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        sent = (key >> np.uint64(32)).astype(np.uint32) if narrow else key
        out = []
        for s in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[s] : cuts[s + 1]]
            out.append(self.row(ASK, sent[at].tobytes(), b"" if aux is None else aux[at].tobytes(), squeeze(flag[at].astype(np.uint8)), gaps(pos[at]), int(s)))
        return out


def tabled(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "uid", "kind", "a", "b", "c", "d"])


class Family:
    """A logarithmic family of sorted key arrays: a new batch is merge-scanned against every level, then becomes a
    level itself, and levels of like size merge, so each key is moved a logarithmic number of times.

    state holds, for each key, flags of what is known: MULTI once it has met itself, MIXED once in another context.
    """

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, key: np.ndarray, aux: np.ndarray, state: np.ndarray) -> None:
        """key rises and is distinct; aux is the context of each; state is changed to what the scan finds."""
        for k, a, s in self.levels:
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            mine = np.flatnonzero(k[at] == key)
            theirs = at[mine]
            apart = np.where(a[theirs] != aux[mine], MIXED, 0) | MULTI
            known = apart | ((s[theirs] | state[mine]) & (MIXED | BLOCK))
            s[theirs] |= known.astype(np.uint8)
            state[mine] |= known.astype(np.uint8)
        if len(key):
            self.levels.append([key, aux, state])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self.merge()

    def merge(self) -> None:
        (k1, a1, s1), (k2, a2, s2) = self.levels.pop(), self.levels.pop()
        k, a, s = np.concatenate((k2, k1)), np.concatenate((a2, a1)), np.concatenate((s2, s1))
        order = np.argsort(k, kind="stable")
        k, a, s = k[order], a[order], s[order]
        first = np.concatenate(([True], k[1:] != k[:-1]))
        self.levels.append([k[first], a[first], np.bitwise_or.reduceat(s, np.flatnonzero(first))])

    def lookup(self, key: np.ndarray) -> np.ndarray:
        while len(self.levels) > 1:
            self.merge()
        if not self.levels:
            return np.zeros(len(key), np.uint8)
        k, _, s = self.levels[0]
        return s[np.searchsorted(k, key)]


def answer(table: pa.Table, aux_kind, narrow: bool, decide: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    """What one shard replies: decide maps the states of asked keys to a status, 0 for no reply."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("uid", "kind", "a", "b", "c", "d")), strict=True), key=lambda r: r[:3])
    out, family, asked = [], Family(), []
    for row in rows:
        if row[1] != ASK:
            out.append(row)
            continue
        key = np.frombuffer(row[2], np.uint32 if narrow else np.uint64)
        aux = np.frombuffer(row[3], aux_kind) if row[3] else np.zeros(len(key), np.uint8)
        flag = expand(row[4], np.uint8)
        order = np.argsort(key, kind="stable")
        k, a, s = key[order], aux[order], flag[order].copy()
        if len(k) and (k[1:] == k[:-1]).any():  # only narrow keys can meet in a batch: then they count as one
            first = np.concatenate(([True], k[1:] != k[:-1]))
            at = np.flatnonzero(first)
            s = np.bitwise_or.reduceat(s, at) | np.where(np.diff(np.append(at, len(k))) > 1, MULTI, 0).astype(np.uint8)
            k, a = k[first], a[first]
        family.add(k, a, s)
        asked.append((row[0], key, row[5]))
    for uid, key, pos in asked:
        status = decide(family.lookup(key))
        told = np.flatnonzero(status)
        if len(told):
            out.append((uid, LOCAL, b"", b"", squeeze(status[told].astype(np.uint8)), gaps(places(pos)[told])))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["uid", "kind", "a", "b", "c", "d"])


def gather(table: pa.Table) -> pa.Table:
    """The answers of one batch, as a row for each document that has any: places counted from its start."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "c", "d")), strict=True))
    told = [(places(r[4]), expand(r[3], np.uint8)) for r in rows if r[0] == LOCAL]
    out = []
    if told:
        ids, h, starts = next((expand(r[1], np.int64), expand(r[2], np.int64), expand(r[3], np.int64)) for r in rows if r[0] == DIRECTORY)
        pos, status = np.concatenate([p for p, _ in told]), np.concatenate([s for _, s in told])
        order = np.argsort(pos, kind="stable")
        pos, status = pos[order], status[order]
        first = np.concatenate(([True], pos[1:] != pos[:-1]))
        status, pos = np.bitwise_or.reduceat(status, np.flatnonzero(first)), pos[first]
        cuts = np.searchsorted(pos, starts)
        for i in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[i], cuts[i + 1])
            out.append((None if ids[i] == np.iinfo(np.int64).min else int(ids[i]), int(h[i]), gaps(pos[at] - starts[i]), squeeze(status[at])))
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "h", "pos", "status"])


#: Bytes of text for which there is a shard more: a shard is held whole, with some 2 bytes for each of these.
SHARD_BYTES = 32 << 20


def shards(docs: DataFrame, text: str = "text") -> int:
    """As many shards as the texts need, however many cores there are: at least two for each partition of a shuffle."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    return max(2 * partitions(docs.sparkSession), -(-total // SHARD_BYTES))


def batch_bytes(shards: int, least: int) -> int:
    """Bytes of a batch: a batch sends a row to each shard, so it grows with their number while a worker can hold it."""
    return min(max(least, shards << 12), 16 << 20)


def ask(requests: DataFrame, aux_kind, narrow: bool, decide: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, h, pos, status of the documents with answers; rows that share id and text count once."""
    answers = requests.groupBy("shard").applyInArrow(lambda t: answer(t, aux_kind, narrow, decide), ANSWER)
    found = answers.groupBy("uid").applyInArrow(gather, FOUND)
    return found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "status")).alias("found"))


def merged(found: list | None) -> tuple[np.ndarray, np.ndarray]:
    """The places and statuses of a document's answers, rising."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    pos = np.concatenate([places(f["pos"]) for f in found])
    status = np.concatenate([expand(f["status"], np.uint8) for f in found])
    order = np.argsort(pos, kind="stable")
    return pos[order], status[order]


def joined(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """docs with the answers of each document as column name, null where there are none."""
    f = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("found").alias(name))
    return docs.join(f, (docs.h == f._h) & docs.doc_id.eqNullSafe(f._id), "left").drop("_id", "_h")
