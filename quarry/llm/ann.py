"""Nearest neighbours by low-dimensional stable projections under a kd-tree, with a chi-square stopping test.

Unit vectors are projected by Gaussian (2-stable) directions. The squared projected distance over the squared true
distance follows a chi-square law with `dims` degrees of freedom, so once the next projected neighbour is so far
that a true neighbour nearer than the k-th found would lie there with probability under 1 - `confidence`, the search
stops. Cells of one kd-tree, fitted on a bounded sample, hold every row; a query visits its own cell first and then
the cells that the test does not rule out. Within a cell projected neighbours are verified in rising order.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """P(chi2 <= x) for an even number of dims: 1 - exp(-x/2) * sum (x/2)**i / i!."""
    half = np.minimum(np.asarray(x, np.float64) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def quantile(confidence: float, dims: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dims) < confidence else (low, middle)
    return high


def directions(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def fit_tree(points: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, left, right) of a kd-tree on medians; axis -1 is a leaf. Constant cells stay whole."""
    nodes: list[tuple[int, float, int, int]] = []

    def grow(at: np.ndarray) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if len(at) > leaf:
            axis = int(np.ptp(points[at], axis=0).argmax())
            cut = float(np.median(points[at, axis]))
            right = points[at, axis] > cut
            if right.any() and not right.all():
                nodes[me] = (axis, cut, grow(at[~right]), grow(at[right]))
        return me

    grow(np.arange(len(points)))
    return nodes


def cell_of(nodes: list, points: np.ndarray) -> np.ndarray:
    """The leaf that holds each point."""
    axis, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(points), np.int64)
    while len(move := np.flatnonzero(axis[at] >= 0)):
        here = at[move]
        at[move] = np.where(points[move, axis[here]] > cut[here], right[here], left[here])
    return at


def cells_within(nodes: list, point: np.ndarray, reach: float) -> list[int]:
    """Leaves whose box lies within squared distance reach of a point."""
    out, stack = [], [(0, np.zeros(len(point)))]
    while stack:
        me, gaps = stack.pop()
        axis, cut, left, right = nodes[me]
        if axis < 0:
            out.append(me)
            continue
        away = gaps.copy()
        away[axis] = max(away[axis], abs(point[axis] - cut))
        near, far = (right, left) if point[axis] > cut else (left, right)
        stack.append((near, gaps))
        if float(away @ away) <= reach:
            stack.append((far, away))
    return out


def _stack(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _verify(queries: pd.DataFrame, points: pd.DataFrame, k: int, limit: float) -> pd.DataFrame:
    """The k best (id, cosine) that each query finds among points: projected neighbours in rising order, verified in
    growing steps until the chi-square test holds. bound carries the k-th cosine known from other cells. seen counts the
    points that each query verified, on the first of its rows, or on a row without a find."""
    rows = []
    if len(points):
        low, vec = _stack(points.low), _stack(points.vec)
        norms = np.sqrt(np.einsum("ij,ij->i", vec, vec))
        sizes = np.einsum("ij,ij->i", low, low)
        ids = points.ids.tolist()
        for q, ql, qv, bound in zip(queries.query_id, queries.low, queries.vec, queries.bound, strict=True):
            qv, ql = np.asarray(qv, np.float64), np.asarray(ql, np.float64)
            qn = math.sqrt(float(qv @ qv))
            near = np.maximum(sizes - 2 * (low @ ql) + ql @ ql, 0)
            # what the bound of other cells rules out is never sorted
            order = np.flatnonzero(near <= limit * max(0.0, 2 - 2 * bound) + 1e-9)
            order = order[np.argsort(near[order], kind="stable")]
            best: list[tuple[float, int]] = []
            at, step = 0, 64
            while at < len(order):
                kth = max(bound, -best[k - 1][0] if len(best) >= k else -2.0)
                if near[order[at]] > limit * max(0.0, 2 - 2 * kth) + 1e-9:
                    break
                some = order[at : at + step]
                cosine = vec[some] @ qv / (norms[some] * qn)
                for i in np.flatnonzero(cosine >= kth - 1e-12):
                    exact = float(np.dot(vec[some[i]], qv)) / (float(norms[some[i]]) * qn)  # one row at a time: alike in any batch
                    best += [(-exact, int(v)) for v in ids[some[i]] if v != q]
                best = sorted(set(best))[:k]
                at, step = at + len(some), step * 2
            rows += [(q, v, -c, at if i == 0 else 0) for i, (c, v) in enumerate(best)] or [(q, None, None, at)]
    found = pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "seen"])
    return found.astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "seen": "int64"})


def nearest(points: DataFrame, is_query, k: int = 5, dims: int = 24, confidence: float = 0.9, sample: int = 32_768, leaf: int = 2048, chunk: int = 4096, block: int = 8192, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, verified: the k nearest by cosine that each query finds, itself left out, and how
    many points it verified.

    is_query is a condition on vec_id. sample bounds the rows that shape the tree (first by a hash of the vector; leaf
    is scaled so that a cell of the whole table holds about that many rows); every row is indexed. Vectors that are
    null, zero, of another width than most, or hold a null or non-finite component take no part. Equal vectors meet
    in one point that keeps its k + 1 least ids, which is all a ranking can name; larger cells are cut into chunks, and
    the queries of a cell into blocks, so that no task holds more than chunk points and block queries, give or take chance.
    Rows that repeat an id count once for each distinct vector. No query or no row gives no row.
    """
    spark = points.sparkSession
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    clean = points.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)")
    first = clean.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    empty = "query_id long, rank int, vec_id long, score double, verified long"
    if first is None:
        return spark.createDataFrame([], empty)
    width = first.w
    clean = clean.where(F.size("vec") == width).dropDuplicates(["vec_id", "vec"])
    least = clean.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = least.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    matrix = directions(width, dims, seed)

    def project(stream):
        for pdf in stream:
            if len(pdf):
                v = _stack(pdf.vec)
                size = np.abs(v).max(axis=1, keepdims=True)
                unit = v / size
                unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
                yield pdf.assign(low=list(unit @ matrix))

    index = checkpointed(distinct.mapInPandas(project, "vec array<double>, ids array<long>, low array<double>"))
    total = index.count()
    shape = index.select("low").orderBy(F.xxhash64("vec")).limit(sample).toPandas() if total > leaf else pd.DataFrame({"low": []})
    size = max(64, int(leaf * min(1.0, len(shape) / max(total, 1))))
    nodes = fit_tree(_stack(shape.low), size) if len(shape) else [(-1, 0.0, 0, 0)]
    limit = quantile(confidence, dims)

    def place(stream):
        for pdf in stream:
            if len(pdf):
                yield pdf.assign(cell=cell_of(nodes, _stack(pdf.low)))

    celled = index.mapInPandas(place, "vec array<double>, ids array<long>, low array<double>, cell long")
    n_chunks = celled.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(chunk))).cast("int").alias("chunks"))
    cells = checkpointed(celled.join(n_chunks, "cell").withColumn("part", F.pmod(F.xxhash64("vec"), F.col("chunks").cast("long")).cast("int")))
    widths = cells.groupBy("cell").agg(F.max("chunks").alias("chunks"))

    def visit(wanted: DataFrame) -> DataFrame:
        """The best of each (query, cell) pair; a query goes to every chunk of its cell."""
        wanted = wanted.select("query_id", "vec", "low", "bound", "cell")
        asks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).join(widths, "cell")
        sent = wanted.join(asks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int"))
        sent = sent.select("query_id", "vec", "low", "bound", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
        held = cells.join(asks.select("cell", "blocks"), "cell").select("cell", "part", "vec", "low", "ids", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        groups = sent.groupBy("cell", "part", "block").cogroup(held.groupBy("cell", "part", "block"))
        return groups.applyInPandas(lambda q, p: _verify(q, p, k, limit), "query_id long, vec_id long, score double, seen long")

    def best(found: DataFrame) -> DataFrame:
        """The first k of each query, and how many points it verified in all."""
        seen = found.groupBy("query_id").agg(F.sum("seen").alias("verified"))
        named = found.where("vec_id IS NOT NULL").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        top = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return top.where(F.col("rank") <= k).join(seen, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")

    asked = clean.where(is_query).select(F.col("vec_id").alias("query_id"), "vec", F.lit(-2.0).alias("bound"))
    asked = checkpointed(asked.mapInPandas(lambda s: (p.assign(ids=[[]] * len(p)) for p in s), "query_id long, vec array<double>, bound double, ids array<long>").mapInPandas(partial(_with_low, project), "query_id long, vec array<double>, bound double, low array<double>"))
    home = asked.mapInPandas(place, "query_id long, vec array<double>, bound double, low array<double>, cell long")
    early = checkpointed(best(visit(home)))
    known = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))

    def onward(stream):
        for pdf in stream:
            own, low = cell_of(nodes, _stack(pdf.low)) if len(pdf) else [], pdf.low.tolist()
            more = [[c for c in cells_within(nodes, np.asarray(p), limit * max(0.0, 2 - 2 * b)) if c != o] for p, b, o in zip(low, pdf.bound, own, strict=True)]
            yield pdf.assign(cell=more)

    rest = asked.drop("bound").join(known, "query_id", "left").select("query_id", "vec", F.coalesce("kth", F.lit(-2.0)).alias("bound"), "low")
    rest = rest.mapInPandas(onward, "query_id long, vec array<double>, bound double, low array<double>, cell array<long>").withColumn("cell", F.explode("cell"))
    first = early.select("query_id", "vec_id", "score", F.when(F.col("rank") == 1, F.col("verified")).otherwise(0).alias("seen"))
    return best(first.unionByName(visit(rest)))


def _with_low(project, stream):
    for pdf in project(stream):
        yield pdf[["query_id", "vec", "bound", "low"]]
