import random
import re

import numpy as np
import xxhash

from quarry.llm import simhash
from tests.llm.helpers import frame, rows


def plain(text, words=4):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    found = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found]
    if not found:
        return 0
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_fingerprints_and_components_equal_brute_force(spark):
    data = rows()
    got = {}
    for r in simhash.near_duplicates(frame(spark, data)).collect():
        got.setdefault(r.doc_id, []).append((r.fp % (1 << 64), r.component_id))
    want_fp = [(d[0], plain(d[1])) for d in data]
    roots = brute([f for _, f in want_fp])
    first = {}
    for i, f in want_fp:
        if i is not None:
            first[roots[f]] = min(first.get(roots[f], i), i)
    want = {}
    for i, f in want_fp:
        want.setdefault(i, []).append((f, first.get(roots[f])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_links_keep_every_component_for_any_blocks(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    want = brute(fps)
    for blocks in (1, 3):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, blocks).collect()
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            a, b = e.a % (1 << 64), e.b % (1 << 64)
            root[find(a)] = find(b)
        assert len({find(f) for f in fps}) == len(set(want.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
