import random
from collections import Counter

import numpy as np

from quarry.llm import exchange, suffixes
from tests.llm.helpers import frame, rows


def brute(data, width):
    texts = [(d[0], (d[1] or "").encode()) for d in data]
    seen = Counter(t[p : p + width] for _, t in texts for p in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        spans, p = [], 0
        while p < len(t):
            q = p
            while q < len(t) and gone[q]:
                q += 1
            if q > p:
                spans.append([p, q])
            p = q + 1 if q == p else q
        out.append((i, bytes(c for c, g in zip(t, gone, strict=True) if not g), spans, len(t)))
    return sorted(out, key=str)


def test_removal_equals_brute_force(spark):
    rng = random.Random(9)
    data = [r for r in rows() if len(r[1] or "") < 9000]
    core = "".join(rng.choice("abcdefghij ") for _ in range(420))
    for i in range(40):
        a, b = sorted(rng.randrange(0, 421) for _ in range(2))
        data.append((3000 + i, f"{rng.random()} {core[a:b]} {rng.random()}{core[b // 2 : b]}", "en", "s", 0))
    got = sorted(((r.doc_id, bytes(r.kept), [list(s) for s in r.spans], r.n_bytes) for r in suffixes.repeated_strings(frame(spark, data)).collect()), key=str)
    assert got == brute(data, 200)


def test_narrow_windows_and_periods(spark):
    rng = random.Random(2)
    data = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))), None, None, None) for i in range(60)] + [(100, "ab" * 70, None, None, None), (101, "a" * 50, None, None, None)]
    got = sorted(((r.doc_id, bytes(r.kept), [list(s) for s in r.spans], r.n_bytes) for r in suffixes.repeated_strings(frame(spark, data), width=24, seed_bytes=8).collect()), key=str)
    assert got == brute(data, 24)


def repeats(texts, width):
    """The bytes that some repeated string covers, for long texts: candidates begin with eight bytes that occur twice."""
    data, starts = b"".join(texts), np.cumsum([0, *map(len, texts)])
    head = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    head = np.ascontiguousarray(head).view(np.uint64).ravel()
    order = np.argsort(head, kind="stable")
    same = head[order][1:] == head[order][:-1]
    again = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    again = [p for p in again.tolist() if p + width <= starts[np.searchsorted(starts, p, side="right")]]
    seen = Counter(data[p : p + width] for p in again)
    gone = np.zeros(len(data), bool)
    for p in again:
        if seen[data[p : p + width]] > 1:
            gone[p : p + width] = True
    return [gone[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def test_a_document_over_16_mib_equals_brute_force(spark):
    letters = np.random.default_rng(4).integers(97, 123, 17 << 20, dtype=np.uint8)
    letters[-5_000:-4_300] = letters[-9_000:-8_300]
    letters[300:550] = letters[-2_000:-1_750]
    long = letters.tobytes()
    texts = [long, long[-700:-400] + b"0123456789" * 9, long[5_000:5_210]]
    data = [(i, t.decode(), None, None, None) for i, t in enumerate(texts)]
    want = [[r.tolist() for r in suffixes.runs(at, at + 1)] for at in map(np.flatnonzero, repeats(texts, 200))]
    assert sum(b > 16 << 20 for _, b in want[0]) == 4
    got = {r.doc_id: r for r in suffixes.repeated_strings(frame(spark, data).coalesce(1)).collect()}
    for i, t in enumerate(texts):
        edges = [0, *sum(want[i], []), len(t)]
        assert [list(s) for s in got[i].spans] == want[i] and got[i].n_bytes == len(t)
        assert bytes(got[i].kept) == b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_family_finds_what_counting_finds():
    rng = np.random.default_rng(1)
    family, seen, contexts, asked = exchange.Family(), Counter(), {}, []
    for _ in range(30):
        key = np.unique(rng.integers(0, 400, rng.integers(1, 90)).astype(np.uint64))
        aux = rng.integers(0, 2, len(key)).astype(np.uint64) * (key % np.uint64(2))
        family.add(key, aux, np.zeros(len(key), np.uint8))
        for k, a in zip(key, aux, strict=True):
            seen[k] += 1
            contexts.setdefault(k, set()).add(a)
        asked.append(key)
    state = family.lookup(np.unique(np.concatenate(asked)))
    for k, s in zip(np.unique(np.concatenate(asked)), state, strict=True):
        assert (s & exchange.MULTI > 0) == (seen[k] > 1) and (s & exchange.MIXED > 0) == (len(contexts[k]) > 1)


def test_empty_table(spark):
    assert suffixes.repeated_strings(frame(spark, [])).count() == 0


def test_shards_follow_the_bytes(spark, monkeypatch):
    assert exchange.shards(suffixes.keyed(frame(spark))) == 8
    monkeypatch.setattr(exchange, "SHARD_BYTES", 1000)
    data = [r for r in rows() if len(r[1] or "") < 9000]
    docs = frame(spark, data)
    n = exchange.shards(suffixes.keyed(docs))
    assert n == -(-sum(len((r[1] or "").encode()) for r in data) // 1000) > 8
    got = sorted(((r.doc_id, bytes(r.kept), [list(s) for s in r.spans], r.n_bytes) for r in suffixes.repeated_strings(docs).collect()), key=str)
    assert got == brute(data, 200)


def test_windows_are_told_apart_by_two_hashes():
    """Windows that agree in the first hash alone must not count as one."""
    family = exchange.Family()
    for check in (1, 2, 2):
        state = np.zeros(1, np.uint8)
        family.add(np.array([7], np.uint64), np.array([check], np.uint32), state)
    assert family.lookup(np.array([7], np.uint64))[0] & exchange.MIXED
    data = b"abcdefgh" * 40
    one, two = suffixes.Strings(data), suffixes.Strings(data, suffixes._OTHER)
    at = np.array([0, 1, 8])
    for s in (one, two):
        assert s.at(at, at + 200)[0] == s.at(at, at + 200)[2] != s.at(at, at + 200)[1]
    assert one.at(at, at + 200)[0] >> np.uint64(32) != two.at(at, at + 200)[0] >> np.uint64(32)
