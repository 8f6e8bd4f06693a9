"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, how near their hits stand to second-person words, capitals,
punctuation, and rates of obfuscated spelling. Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, checkpointed
from quarry.llm.gbt import Forest, Isotonic, fit, isotonic

#: Insults and slurs of general use, and second-person words, of four languages.
INSULTS = frozenset("""idiot idiots moron morons clown clowns pathetic worthless scum trash garbage disgusting stupid dumb loser losers
fool jerk filth vermin useless ugly shut hate kill die idiota imbecil estupido basura asqueroso inutil payaso patetico escoria
imbecile debile abruti ordure minable pitoyable degoutant salaud cretin dumm dummkopf trottel abschaum widerlich wertlos
mull erbarmlich versager blod""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur youre tu te ti tus usted ustedes vos vous votre vos toi ton ta du dich dir dein deine euch ihr".split())
#: Signs that stand for letters in disguised words.
_LEET = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[\d@$!*|.\-_]+[^\W\d_]+)+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_SQUEEZE = re.compile(r"(.)\1+")
_CLASS = np.zeros(256, np.int64)
for _signs, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"!", 4), (b"?", 5), (b"#$%&*@~^", 6), (b".,;:'\"()-", 7), (b" \t\r\n\v\f", 8)):
    _CLASS[list(_signs)] = _kind
WIDTH = 26
#: Letters of a stem; stems stand in the lexicon as ^ and these letters.
STEM = 4


def features(data: bytes, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a UTF-8 text; all zero but for the length terms if it is empty."""
    text = data.decode("utf-8", "replace")
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words) or 1
    learned = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    stems = [lexicon[k] for w in words if len(w) > STEM and (k := "^" + w[:STEM]) in lexicon]
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
    hits = np.array(sorted({*fixed, *(i for i, _ in learned)}))
    near = 0.0
    if len(hits) and len(second):
        place = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(hits - second[np.maximum(place - 1, 0)]), np.abs(hits - second[np.minimum(place, len(second) - 1)]))
        near = float((1 / (1 + gap)).sum())
    mixed = _MIXED.findall(lower)
    disguised = 0
    for w in mixed:
        plain = "".join(c for c in w.translate(_LEET) if c.isalpha())
        disguised += plain in INSULTS or plain in lexicon or _SQUEEZE.sub(r"\1", plain) in INSULTS
    repeats = len(_REPEAT.findall(lower))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) if data else np.zeros(9)
    size, letters = len(data) or 1, int(kinds[1] + kinds[2]) or 1
    weight = [v for _, v in learned]
    up, kinds_hit = sum(weight), len({words[i] for i, _ in learned})
    return [
        math.log1p(len(words)), len(fixed) / n, math.log1p(len(fixed)), up / n, math.log1p(up), len(stems) / n,
        max(weight, default=0.0), len(learned) / n, float(len(learned)), float(kinds_hit), near / n, near,
        len(second) / n, kinds[1] / letters, sum(w.isupper() and len(w) > 2 for w in text.split()) / n if kinds[1] > 2 else 0.0,
        kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size, kinds[3] / size,
        len(mixed) / n, disguised / n, float(disguised), repeats / n, sum(stems), max(stems, default=0.0),
    ]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    forest: Forest
    calibration: Isotonic

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], np.float64).reshape(-1, WIDTH)
        return self.calibration(self.forest.probability(x))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 20_000, lexicon_size: int = 256, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows of docs.

    sample bounds the labelled documents that are fitted, the first by a hash of their ids; lexicon_size bounds the
    learned words and stems, and least_docs is the number of toxic documents that a term needs. Calibration is fitted
    on scores of a row by a lexicon and trees that did not see it: each half of the sample learns both for the other.
    Null labels and ids take no part; a document labelled twice counts once, with the larger label. Without a labelled
    row, or with one class only, the model scores by the fixed lexicon's prior.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids of 12 bytes
    rows = checkpointed(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")))
    found = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)"))
    terms = F.array_union(found, F.transform(F.filter(found, lambda w: F.length(w) > STEM), lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM))))
    second = F.col("half") == 1
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos"), F.count_if(second).alias("n1"), F.coalesce(F.sum(F.when(second, F.col("y"))), F.lit(0)).alias("pos1")).first()
    one = lambda c: F.sum(F.when(second, c).otherwise(0))
    counted = rows.select("y", "half", F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("p"), one(F.lit(1)).alias("c1"), one(F.col("y")).alias("p1"))
    counted = checkpointed(counted.where(F.col("p") >= least_docs))

    def words(c, p, n: int, pos: int) -> dict[str, float]:
        weight = F.log((p + 0.5) / (pos + 1.0)) - F.log((c - p + 0.5) / (n - pos + 1.0))
        rated = counted.where(p >= least_docs).select("term", weight.alias("w"), ((p - 1.5 * F.sqrt(p)) * weight).alias("told"))
        return {r.term: float(r.w) for r in rated.where("w >= 2.0").orderBy(F.desc("told"), "term").limit(lexicon_size).collect()}

    c, p, c1, p1 = (F.col(k) for k in ("c", "p", "c1", "p1"))
    pos, pos1 = int(total.pos), int(total.pos1)
    lexicons = [words(c, p, total.n, pos), words(c - c1, p - p1, total.n - total.n1, pos - pos1), words(c1, p1, total.n1, pos1)]

    def run(stream):
        for batch in stream:
            x = [sum((features(t, lexicon) for lexicon in lexicons), []) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("half"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "half", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, half int, x array<double>").toArrow().to_pydict()
    order = np.lexsort((got["doc_id"],)) if got["doc_id"] else np.empty(0, np.int64)
    every = np.array(got["x"], np.float64).reshape(-1, 3, WIDTH)[order]
    y, half = np.array(got["y"], np.float64)[order], np.array(got["half"], np.int64)[order]
    x, parts = every[:, 0], [half == 0, half == 1]
    if not len(y) or y.min() == y.max():
        return Model(lexicons[0], fit(x, y), Isotonic(np.empty(0), np.empty(0)))
    if min(part.sum() for part in parts) == 0:  # one document: nothing is unseen
        return Model(lexicons[0], fit(x, y), Isotonic(np.empty(0), np.empty(0)))
    unseen = np.zeros(len(y))
    for k in (0, 1):
        seen = every[:, 1 + k]
        unseen[~parts[k]] = fit(seen[parts[k]], y[parts[k]]).probability(seen[~parts[k]])
    return Model(lexicons[0], fit(x, y), isotonic(unseen, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score in 0..1 of every row; null and empty texts are scored like any text without words."""

    def run(stream):
        for batch in stream:
            texts, scores = as_bytes(batch.column("text")), []
            for at in range(0, len(texts), 1000):
                scores.append(model.score(texts[at : at + 1000]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.empty(0))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(stream):
        for batch in stream:
            texts = as_bytes(batch.column(place))
            civil = np.concatenate([model.score(texts[at : at + 1000]) < threshold for at in range(0, len(texts), 1000)] or [np.empty(0, bool)])
            yield batch.filter(pa.array(civil))

    return docs.mapInArrow(run, docs.schema)
