import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quarry.llm import packing
from tests.llm.helpers import frame, rows


def test_price_is_the_best_pattern():
    lengths, value = np.array([3, 5, 7]), np.array([0.31, 0.5, 0.74])
    worth, counts = packing.price(value, lengths, 20)
    best = max(value @ [a, b, c] for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert abs(worth - best) < 1e-9 and counts @ lengths <= 20 and abs(counts @ value - best) < 1e-9


def test_plans_hold_every_piece_and_little_air():
    rng = np.random.default_rng(0)
    lengths = np.arange(1, 129)
    counts = rng.integers(0, 400, 128)
    counts[63:] //= 2
    plan = packing.solve(lengths, counts, 128)
    assert sum(n * p for n, p in plan).tolist() == counts.tolist() and all(p @ lengths <= 128 for _, p in plan)
    assert sum(n for n, _ in plan) * 128 <= 1.02 * (counts @ lengths)
    assert packing.solve(np.array([], np.int64), np.array([], np.int64), 128) == []


def test_packs_whole_documents_into_sequences(spark):
    data = [*rows(), (920, "a <|endoftext|> b", None, None, None)]
    got = packing.pack(frame(spark, data)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for d in data:
        want[d[0]].append([*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 0])
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append((r.doc_tokens, r.start, tuple(r.payload)))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.payload) == r.length <= 1024
    assert docs.keys() == want.keys()
    for i, lists in want.items():
        assert sorted(docs[i]) == sorted((len(x), at, tuple(x[at : at + 1024])) for x in lists for at in range(0, len(x), 1024))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_digest_payload_and_empty_table(spark):
    got = packing.pack(frame(spark, [(1, None, None, None, None)]), payload=packing.crc32_of, payload_type=pa.int64()).collect()
    assert [(r.doc_id, r.payload, r.length, r.offset) for r in got] == [(1, zlib.crc32(bytes(4)), 1, 0)]
    assert packing.pack(frame(spark, [])).count() == 0
