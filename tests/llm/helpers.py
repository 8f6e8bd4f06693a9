"""Small documents with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Iota", "kappa", "é", "über", "x1"]) + str(rng.randrange(40)) for _ in range(n))


def rows(seed=5, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 160)) for _ in range(n)]
    shared = words(rng, 90)
    out = [(i, t, "en", "src0", len(t)) for i, t in enumerate(base)]
    for i in range(10):
        out.append((len(out), f"{words(rng, 12)} {shared} {words(rng, 9)}", "en", "src1", 0))
        out.append((len(out), base[i], "en", "src1", 0))
        out.append((len(out), base[i + 10] + " tail", None, None, None))
    long = words(rng, 6000)
    out += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \t\n ", "en", "s", 3), (903, long, "en", "s", 1), (904, long[500:9000], "en", "s", 1), (905, "one", "en", "s", 3), (None, base[3], None, None, None), (905, "one", "en", "s", 3)]
    out += [(910, "ab " * 400, "en", "s", 1), (911, "z" * 3000, "en", "s", 1), (912, "z" * 900, "en", "s", 1)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
