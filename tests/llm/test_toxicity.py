import random

import numpy as np

from quarry.llm import gbt, toxicity
from tests.llm.helpers import frame, words


def test_trees_learn_an_interaction_and_are_repeatable():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    a, b = gbt.fit(x[:3000], y[:3000]), gbt.fit(x[:3000], y[:3000])
    assert ((a.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert np.array_equal(a.margin(x), b.margin(x))


def test_isotonic_is_rising_and_calibrated():
    rng = np.random.default_rng(2)
    s = rng.random(5000)
    y = (rng.random(5000) < s**2).astype(float)
    c = gbt.isotonic(s, y)
    at = np.linspace(0, 1, 101)
    assert (np.diff(c(at)) > 0).all() and np.abs(c(at) - at**2).max() < 0.12
    assert len(gbt.isotonic(np.empty(0), np.empty(0)).x) == 0


def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        t = words(rng, rng.randrange(5, 80)).split()
        if bad:
            for _ in range(1 + len(t) // 20):
                t.insert(rng.randrange(len(t)), rng.choice(["grobnak", "grobzul", "idiot", "flemmit"]))
        docs.append((i, " ".join(t), None, None, None))
        labels.append((i, int(bad)))
    docs += [(950, None, None, None, None), (951, "", "x", "y", 0), (None, "idiot", None, None, None)]
    labels += [(None, 1), (3, None)]
    frame_ = frame(spark, docs)
    train = spark.createDataFrame([r for r in labels if r[0] is None or r[0] % 3], "doc_id long, toxic int")
    model = toxicity.learn(frame_, train)
    got = {r.doc_id: r.score for r in toxicity.score(frame_, model).collect()}
    assert len(got) == 903 and all(0 <= s <= 1 for s in got.values()) and got[950] == got[951]
    held = [(got[i] >= 0.7, y) for i, y in labels if i is not None and y is not None and i % 3 == 0]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.95
    assert {r.doc_id for r in toxicity.keep_civil(frame_, model).collect()} == {i for i, s in got.items() if s < 0.7}


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark), none)
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame(spark), model).collect())
    assert toxicity.score(frame(spark, []), toxicity.learn(frame(spark, []), none)).count() == 0


def test_features_by_hand():
    lexicon = {"grob": 3.0, "^flem": 2.5}
    x = toxicity.features(b"You IDIOT, grob! id1ot sooo @x flemmit", lexicon)
    assert len(x) == toxicity.WIDTH
    assert abs(x[0] - np.log1p(7)) < 1e-12
    assert abs(x[1] - 1 / 7) < 1e-12 and abs(x[3] - 3 / 7) < 1e-12 and abs(x[5] - 1 / 7) < 1e-12  # lists, learned words, stems
    assert abs(x[11] - (1 / 2 + 1 / 3)) < 1e-12  # hits one and two words from "you"
    assert abs(x[12] - 1 / 7) < 1e-12 and x[14] == 1 / 7  # second person; words in capitals
    assert x[15] == 1 / 38 and x[22] == 1.0 and abs(x[23] - 1 / 7) < 1e-12  # exclamation marks; disguised; repeated letters
    empty = toxicity.features(b"", lexicon)
    assert empty == toxicity.features(b" ", lexicon)[:18] + empty[18:] and not any(empty)
    assert len(toxicity.features(("wört " * 200_000).encode(), lexicon)) == toxicity.WIDTH


def test_halves_learn_their_own_words(spark):
    """A word that only a few toxic documents hold must not calibrate itself."""
    rng = random.Random(6)
    docs = [(i, words(rng, 30) + (f" rare{i % 4}" if i % 10 == 0 else ""), None, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, docs), labels, least_docs=3)
    assert set(model.lexicon) >= {f"rare{k}" for k in range(0, 4, 2)} and len(model.calibration.x)


def test_registered_query_on_held_out_documents(spark):
    import zlib

    from quarry.llm.registry import op10_toxicity

    sf = "/root/testdata/sf0.01"
    got = op10_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert held and sum(p == y for p, y in held) / len(held) > 0.9
