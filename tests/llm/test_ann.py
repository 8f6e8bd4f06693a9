import math

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k=5):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    got = {}
    for q, a in good:
        if q % 5 == 0:
            a = np.array(a, np.float32).astype(float)
            scored = sorted((-float(a @ b) / math.sqrt(float(a @ a)) / math.sqrt(float(b @ b)), i) for i, b in ((i, np.array(v, np.float32).astype(float)) for i, v in good) if i != q)
            got[q] = [i for _, i in scored[:k]], [-s for s, _ in scored[:k]]
    return got


def test_chi_square():
    assert abs(ann.chi_square_cdf(np.array(15.507), 8) - 0.95) < 1e-4 and abs(ann.quantile(0.95, 8) - 15.507) < 1e-2


def test_recall_against_brute_force_over_several_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(900)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[7], 0) for i in range(40)]
    rows += [(2000, None, 0), (2005, [0.0] * 16, 0), (2010, [float("nan")] * 16, 0), (2015, [1.0, None] * 8, 0), (None, vectors[3], 0), (2020, [1.0], 0), (5, vectors[5], 0)]
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, leaf=64, chunk=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, ([], []))
        assert r.rank == len(got[r.query_id][0]) + 1
        got[r.query_id][0].append(r.vec_id)
        got[r.query_id][1].append(r.score)
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q][0]) & set(want[q][0])) for q in want) / sum(len(w) for w, _ in want.values())
    assert hits >= 0.97
    assert all(abs(a - b) < 1e-9 for q in want if got[q][0] == want[q][0] for a, b in zip(got[q][1], want[q][1], strict=True))
    assert got[1000][0] == [7, 1001, 1002, 1003, 1004]


def test_the_stopping_test_spares_most_points(spark):
    """On clustered vectors over many cells, with blocks of queries: recall holds and few points are verified."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    vectors = [(centres[i % 40] + 0.15 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(4000)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    found = ann.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, leaf=128, block=100).collect()
    got, seen = {}, {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        seen[r.query_id] = r.verified
    want = brute(rows)
    assert got.keys() == want.keys() and all(len(g) == 5 for g in got.values())
    assert sum(len(set(got[q]) & set(want[q][0])) for q in want) >= 0.95 * 5 * len(want)
    assert sum(seen.values()) < 0.25 * len(rows) * len(seen)


def test_few_rows_and_empty(spark):
    assert ann.nearest(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    got = ann.nearest(table(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)]), F.col("vec_id") % 5 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 1)]
