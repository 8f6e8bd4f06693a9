import random
import re
from collections import Counter

from quarry.llm import blocks
from tests.llm.helpers import frame, rows


def brute(data, width):
    texts = [(d[0], re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in data]
    seen = Counter(tuple(t[p : p + width]) for _, t in texts for p in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if seen[tuple(t[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        out.append((i, " ".join(w for w, g in zip(t, gone, strict=True) if not g), len(t), sum(gone)))
    return sorted(out, key=str)


def got(spark, data, width):
    found = blocks.repeated_runs(frame(spark, data), width).collect()
    return sorted(((r.doc_id, r.kept, r.n_words, sum(b - a for a, b in r.spans)) for r in found), key=str)


def test_removal_equals_brute_force(spark):
    data = rows()
    assert got(spark, data, 35) == brute(data, 35)


def test_narrow_windows_over_few_words(spark):
    rng = random.Random(6)
    data = [(i, " ".join(["x"]) + " " + "  ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))), None, None, None) for i in range(50)]
    for width in (5, 8):
        assert got(spark, data, width) == brute(data, width)


def test_empty_table(spark):
    assert blocks.repeated_runs(frame(spark, [])).count() == 0
