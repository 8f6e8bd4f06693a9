"""The registered queries over whole tables, against plain Python: digests, counts and formats included."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import packing, registry, suffixes
from tests.llm.test_simhash import brute as groups
from tests.llm.test_simhash import plain
from tests.llm.test_suffixes import repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op1(spark):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    unit = np.stack([rows[i] / np.sqrt(rows[i] @ rows[i]) for i in ids])
    got = defaultdict(list)
    for r in registry.op1_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        scores = unit @ unit[np.searchsorted(ids, q)]
        best = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:5]
        hits += len({v for _, v, _ in found} & set(best))
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - scores[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in found)
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
    assert hits >= 0.9 * 5 * len(got)


def test_op2(spark, docs):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in registry.op2_packing(spark, SF).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in docs:
        ids = packing.ids_of(text, packing.default_vocabulary())
        total += len(ids)
        got = sorted(pieces[i])
        assert [a for a, *_ in got] == [0, *np.cumsum([n for _, n, *_ in got])[:-1]] and sum(n for _, n, *_ in got) == len(ids)
        assert all(crc == zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) and t == len(ids) for a, n, crc, t in got)
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 1024
    assert len(places) <= 1.02 * total / 1024 + 2


def test_ids_equal_the_other_reader_of_the_vocabulary():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    theirs, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(12)
    signs = ["a", "the", "The", "é", "ß", "日本", "🙂", "́", " ", "  ", "\n", "\r\n", "\t", " ", "'s", "'LL", "123", "4", "-", "…", "\x00", "‍", "<|endoftext|>", "Ω", "ـ", "_", "("]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + ["x" * 5000, " " * 3000, "ab " * 4000]
    for text in texts:
        assert packing.ids_of(text, packing.default_vocabulary()).tolist() == [*theirs.encode(text, add_special_tokens=False).ids, 0]


def test_op6(spark, docs):
    texts = [t.encode() for _, t in docs]
    got = {r.doc_id: r for r in registry.op6_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, _), data, gone in zip(docs, texts, repeats(texts, 200), strict=True):
        spans = suffixes.runs(*(np.flatnonzero(gone) + k for k in (0, 1)))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 0


def test_op7(spark, docs):
    fps = {i: plain(t) for i, t in docs}
    root = groups(list(fps.values()))
    first = {}
    for i, f in fps.items():
        first[root[f]] = min(first.get(root[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op7_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", first[root[f]]) for i, f in fps.items()} and len(set(first.values())) < len(fps)


def test_op8(spark, docs):
    words = {i: t.encode().split() for i, t in docs}
    seen = Counter(tuple(w[p : p + 35]) for w in words.values() for p in range(len(w) - 34))
    got = {r.doc_id: r for r in registry.op8_blocks(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
