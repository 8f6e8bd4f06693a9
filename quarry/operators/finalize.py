"""The greedy tail of a search: from a bounded pool of candidates to hits. One Python call a query, over at most the
candidates of its phrases; everything before it is relational."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The weights of the learned relevance, by feature, and its bias.
RELEVANCE = {
    "fine": 0.831619, "fine_missing": 0.0, "coarse": -0.583163, "inverse_bm25_rank": 1.25367, "bm25_missing": -0.659836,
    "phrases": -0.0275815, "decl_share": 0.329578, "path_share": 0.468366, "chunk_windows": 2.75082,
}
BIAS = -4.93661


@dataclass(frozen=True)
class Finalize:
    """What shapes the tail; the defaults are those a search uses."""

    k: int = 5
    dedupe_overlap: float = 0.0
    fine_lines: int = 6
    fine: bool = True
    fine_blend: float = 1.0
    min_score: float = 0.0
    learned_blend: float = 0.5
    diversify: bool = True
    mmr_lambda: float = 0.75
    bm25_pin: int = 5
    keep_coarse_top: bool = False
    dims: int = 32


@dataclass
class Row:
    """A candidate on its way to a hit."""

    path: str
    start: int
    end: int
    lines: list[str]
    score: float
    phrases: int = 1
    bm25_rank: int | None = None
    decl_share: float = 0.0
    path_share: float = 0.0
    fine: tuple[int, int, float, int] | None = None  # first line, last line, cosine, phrase
    vector: np.ndarray | None = field(default=None, repr=False)


_WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """The code-aware tokens of text, as `functions.text.text_tokens` has them."""
    out = []
    for word in _WORD.findall(text):
        seams = [i for i in range(1, len(word)) if word[i].isupper() and (word[i - 1].islower() or word[i - 1] in "0123456789" or word[i - 1].isupper() and i + 1 < len(word) and word[i + 1].islower())]
        parts = [word[a:b] for a, b in zip([0, *seams], [*seams, len(word)], strict=True)]
        out += [p.lower() for p in (parts + [word] if seams else parts) if len(p) >= 2]
    return out


@lru_cache(1 << 16)
def token_vector(term: str, dims: int) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{term}#{d}".encode()).hexdigest()[:8], 16) / 2147483647.5 - 1 for d in range(dims)])


def embed(text: str, dims: int) -> np.ndarray:
    """The pooled vector of text as an index stores it; zeros without tokens."""
    found = tokens(text)
    v = sum((token_vector(t, dims) for t in found), np.zeros(dims))
    size = math.sqrt(float(v @ v))
    return np.rint(np.clip(v / size * 127, -127, 127)) / 127 if size else v


def scaled(values: list[float], flat: float) -> list[float]:
    low, high = min(values), max(values)
    return [(v - low) / (high - low) if high > low else flat for v in values]


def overlapping(a: tuple[int, int], b: tuple[int, int], share: float) -> bool:
    """Whether two inclusive spans share a line, or at share over 0 that part of the shorter."""
    both = min(a[1], b[1]) - max(a[0], b[0]) + 1
    return both >= 1 if share <= 0 else both >= share * min(a[1] - a[0] + 1, b[1] - b[0] + 1)


def dedupe(rows: list[Row], share: float) -> list[Row]:
    """In rank order, a row that overlaps a kept one of its file hands it its phrases and lexical rank."""
    kept: list[Row] = []
    for row in rows:
        held = next((k for k in kept if k.path == row.path and overlapping((k.start, k.end), (row.start, row.end), share)), None)
        if held is None:
            kept.append(row)
            continue
        held.phrases |= row.phrases
        ranks = [r for r in (held.bm25_rank, row.bm25_rank) if r is not None]
        held.bm25_rank = min(ranks) if ranks else None
    return kept


def fine_window(row: Row, queries: list[np.ndarray], height: int, dims: int) -> tuple[int, int, float, int] | None:
    """The best window of height lines by cosine to the phrases that found the row; the earliest of equals, without its
    blank edges."""
    best, h = None, min(height, len(row.lines))
    for at in range(len(row.lines) - h + 1) if h else ():
        text = "\n".join(row.lines[at : at + h])
        if not text.strip():
            continue
        v = embed(text, dims)
        for p, q in enumerate(queries):
            if row.phrases >> p & 1 and (best is None or float(v @ q) > best[2]):
                best = at, at + h - 1, float(v @ q), p
    if best is None:
        return None
    first, last = best[:2]
    while first < last and not row.lines[first].strip():
        first += 1
    while last > first and not row.lines[last].strip():
        last -= 1
    return row.start + first, row.start + last, best[2], best[3]


def fine_rerank(rows: list[Row], queries: list[np.ndarray], how: Finalize) -> tuple[list[Row], list[float], list[float]]:
    """Rows by their fine windows; the relevance of each; the best cosine of each phrase. Rows without a window come
    after those with one, and a window that half covers a better one of its file goes to the tail."""
    for row in rows:
        row.fine = fine_window(row, queries, how.fine_lines, how.dims)
    signal = [max((r.fine[2] for r in rows if r.fine and r.fine[3] == p), default=-math.inf) for p in range(len(queries))]
    have, rest = [r for r in rows if r.fine], [r for r in rows if not r.fine]
    relevance: list[float] = []
    if have:
        fine, coarse = scaled([r.fine[2] for r in have], 1.0), scaled([r.score for r in have], 1.0)
        worth = [how.fine_blend * f + (1 - how.fine_blend) * c for f, c in zip(fine, coarse, strict=True)]
        order = sorted(range(len(have)), key=lambda i: (-worth[i], i))
        kept, again = [], []
        for i in order:
            near = any(have[j].path == have[i].path and overlapping(have[j].fine[:2], have[i].fine[:2], 0.5) for j in kept)
            (again if near else kept).append(i)
        relevance = [worth[i] for i in kept]
        rest = [have[i] for i in again] + rest
        have = [have[i] for i in kept]
    low = min(relevance, default=0.0)
    return have + rest, relevance + [low - 0.001 * (i + 1) for i in range(len(rest))], signal


def learned(rows: list[Row], relevance: list[float], blend: float) -> tuple[list[Row], list[float]]:
    """Relevance mixed with a logistic model of how the rows were found."""
    fines = [r.fine[2] for r in rows if r.fine]
    low, high = (min(fines), max(fines)) if fines else (0.0, 0.0)
    coarse = scaled([r.score for r in rows], 0.5)
    odds = []
    for row, c in zip(rows, coarse, strict=True):
        x = {
            "fine": ((row.fine[2] - low) / (high - low) if high > low else 0.5) if row.fine else 0.0, "fine_missing": float(row.fine is None), "coarse": c,
            "inverse_bm25_rank": 1 / row.bm25_rank if row.bm25_rank else 0.0, "bm25_missing": float(row.bm25_rank is None), "phrases": float(row.phrases.bit_count()),
            "decl_share": row.decl_share, "path_share": row.path_share, "chunk_windows": (row.end - row.start + 1) / 32,
        }
        odds.append(1 / (1 + math.exp(-(BIAS + sum(RELEVANCE[k] * v for k, v in x.items())))))
    mixed = [(1 - blend) * r + blend * o for r, o in zip(scaled(relevance, 0.5), odds, strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (-mixed[i], i))
    return [rows[i] for i in order], [mixed[i] for i in order]


def mmr(relevance: list[float], vectors: list[np.ndarray | None], k: int, weight: float) -> list[int]:
    """Positions by weight * relevance - (1 - weight) * the nearest chosen, one after another; ties to the first."""
    worth, left, out = scaled(relevance, 0.0), list(range(len(relevance))), []

    def cosine(a, b) -> float:
        if a is None or b is None:
            return 0.0
        size = math.sqrt(float(a @ a) * float(b @ b))
        return float(a @ b) / size if size else 0.0

    while left and len(out) < k:
        best = max(left, key=lambda i: (weight * worth[i] - (1 - weight) * max([0.0, *(cosine(vectors[i], vectors[j]) for j in out)]), -i))
        out.append(best)
        left.remove(best)
    return out


def floor_mask(signal: list[float], least: float) -> int:
    """The phrases whose best signal is known and under least, as bits."""
    return sum(1 << p for p, s in enumerate(signal) if math.isfinite(s) and s < least)


def finalize(rows: list[Row], phrases: list[str], how: Finalize) -> list[tuple[Row, float]]:
    """Dedupe, fine windows, floor, learned relevance, diversity, then the guarantees: a hit for each phrase, and the
    pinned rows."""
    rows = dedupe([replace(r) for r in rows], how.dedupe_overlap)
    if not rows:
        return []
    top, queries = rows[0], [embed(p, how.dims) for p in phrases]
    relevance, signal = [r.score for r in rows], []
    if how.fine and how.fine_lines >= 1:
        rows, relevance, signal = fine_rerank(rows, queries, how)
    floored = 0
    if how.min_score > 0:
        if not signal:
            signal = [max((float(r.vector @ q) for r in rows if r.vector is not None), default=-math.inf) for q in queries]
        floored = floor_mask(signal, how.min_score)
        if floored == (1 << len(phrases)) - 1 and any(map(math.isfinite, signal)):
            return []
        stay = [i for i, r in enumerate(rows) if not floored or r.phrases & ~floored]
        rows, relevance = [rows[i] for i in stay], [relevance[i] for i in stay]
    if how.learned_blend > 0 and rows:
        rows, relevance = learned(rows, relevance, how.learned_blend)
    order = mmr(relevance, [r.vector for r in rows], how.k, how.mmr_lambda) if how.diversify and len(rows) > how.k > 1 else list(range(min(how.k, len(rows))))
    used = set(order)
    if len(phrases) > 1:
        of = lambda i: rows[i].fine[3] if rows[i].fine else None
        for p in range(len(phrases)):
            if floored >> p & 1 or any(of(i) == p for i in order):
                continue
            spare = [i for i in range(len(rows)) if i not in used and of(i) == p]
            if not spare:
                continue
            best = max(spare, key=lambda i: (rows[i].fine[2], i))
            used.add(best)
            if len(order) < how.k:
                order.append(best)
            else:
                shown = [of(i) for i in order]
                order[max(range(len(order)), key=lambda s: (shown.count(shown[s]), s))] = best
    pins = sorted((r.bm25_rank, i) for i, r in enumerate(rows) if r.bm25_rank is not None and r.bm25_rank <= how.bm25_pin)
    wanted = [i for i, r in enumerate(rows) if how.keep_coarse_top and r is top] + [i for _, i in pins]
    for want in wanted:
        if want in order:
            continue
        if len(order) < how.k:
            order.append(want)
        elif free := [s for s in range(len(order)) if order[s] not in wanted]:
            order[free[-1]] = want
    return [(rows[i], rows[i].fine[2] if rows[i].fine else rows[i].score) for i in order]


def best_line(lines: list[str], first: int, query: set[str]) -> tuple[int, str]:
    """The line that shares most tokens with the query, those with a letter or digit before others, the first of equals."""
    rank = [(-len(query & set(tokens(x))), not any(c.isalnum() for c in x), i) for i, x in enumerate(lines)]
    i = min(rank)[2]
    return first + i, lines[i]


HITS = "query_id long, rank int, path string, start_line int, end_line int, line int, text string, score double, chunk_start_line int, chunk_end_line int, phrase int, bm25_rank int, phrases int, decl_share double, path_share double"


def hits(pool: DataFrame, phrases: DataFrame, how: Finalize = Finalize()) -> DataFrame:
    """HITS of each query. pool: query_id, rank, path, start_line, end_line, body, score, phrases, bm25_rank, decl_share,
    path_share of its candidates; phrases: query_id, list of phrases."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "path", "start_line"])
        asked = list(pdf.asked.iloc[0])
        rows = []
        for r in pdf.itertuples(index=False):
            row = Row(r.path, int(r.start_line), int(r.end_line), r.body.split("\n"), float(r.score), int(r.phrases), None if pd.isna(r.bm25_rank) else int(r.bm25_rank), float(r.decl_share), float(r.path_share))
            row.vector = embed(f"{r.path}\n{r.body}", how.dims)
            rows.append(row)
        out = []
        for rank, (row, score) in enumerate(finalize(rows, asked, how), 1):
            start, end = row.fine[:2] if row.fine else (row.start, row.end)
            phrase = row.fine[3] if row.fine else 0
            line, text = best_line(row.lines[start - row.start : end - row.start + 1], start, set(tokens(asked[phrase])))
            out.append((int(pdf.query_id.iloc[0]), rank, row.path, start, end, line, text, score, row.start, row.end, phrase, row.bm25_rank, row.phrases, row.decl_share, row.path_share))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in HITS.split(", ")])
        return frame.astype({"bm25_rank": "Int32"})

    return pool.join(phrases.select("query_id", F.col("phrases").alias("asked")), "query_id").groupBy("query_id").applyInPandas(run, HITS)
