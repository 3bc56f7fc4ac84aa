"""Approximate nearest neighbours by cosine: few Gaussian projections indexed by a kd-tree.

Vectors are scaled to length one and projected on `DIMS` Gaussian directions (a stable law), so a projected squared distance
is the true one times a chi-square variable with `DIMS` degrees of freedom. Projected neighbours are looked at in growing
distance and verified with the whole vectors, until a vector as near as the present k-th would, with probability `SURE`,
have been met before: the chi-square test.

On the cluster the top of the kd-tree is built on a bounded sample and cuts the projected space into cells. Every distinct
vector lies in one cell (and one block of it, if the cell is large), which has its own kd-tree. A query first searches its
home cell; the distance found there bounds the cells that the test still asks for, and only those get it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltable.plans.lineage import materialize

DIMS, SURE, SEED = 8, 0.985, 17
#: Vectors on which the top of the tree is built, and distinct vectors and queries in a block at most (about).
SAMPLE, BLOCK, LEAF = 8192, 1024, 32
#: Salts over which equal vectors are dealt before their smallest ids are picked.
SALTS = 16


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 50.0 * dims
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def _projection(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, DIMS))


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)  # so that no square over- or underflows
    v = v / scale
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    top, ab = (np.abs(x).max(axis=1) for x in (a, b))
    a, b = a / top[:, None], b / ab[:, None]
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Cells:
    """The top of the kd-tree: `depth` levels of median splits, each along the direction in which its part is widest."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, n = depth, 1 << depth
        self.dim, self.cut = np.zeros(n, int), np.zeros(n)
        self.low, self.high = np.full((n, DIMS), -np.inf), np.full((n, DIMS), np.inf)
        self._split(points, 1, self.low[0].copy(), self.high[0].copy())

    def _split(self, points: np.ndarray, node: int, low: np.ndarray, high: np.ndarray) -> None:
        if node >> self.depth:
            cell = node - (1 << self.depth)
            self.low[cell], self.high[cell] = low, high
            return
        dim = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
        cut = float(np.median(points[:, dim])) if len(points) else 0.0
        self.dim[node], self.cut[node] = dim, cut
        below, above = high.copy(), low.copy()
        below[dim] = above[dim] = cut
        left = points[:, dim] <= cut
        self._split(points[left], 2 * node, low, below)
        self._split(points[~left], 2 * node + 1, above, high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.cut[node])
        return node - (1 << self.depth)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Least squared distance from each point to each cell."""
        return _to_boxes(points, self.low, self.high)


def _to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(low)))
    for d in range(low.shape[1]):
        x = points[:, d: d + 1]
        total += np.maximum(0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
    return total


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            done.append(own)
            continue
        spread = points[own]
        order = own[np.argpartition(spread[:, int(np.argmax(spread.max(axis=0) - spread.min(axis=0)))], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2:]]
    return done


def search(queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray, k: int):
    """(squared distances, numbers) of up to k + 2 near vectors of each query, nearest first; `bound` is a squared distance
    within which k vectors are known already. Missing ones have an infinite distance."""
    matrix, limit, keep = _projection(vectors.shape[1]), chi_square_quantile(SURE), k + 2
    q, v = _unit(queries), _unit(vectors)
    qp, vp = q @ matrix, v @ matrix
    leaves = _leaves(vp)
    low, high = (np.array([f(vp[own], axis=0) for own in leaves]) for f in (np.min, np.max))
    members = np.full((len(leaves), LEAF), -1)
    for i, own in enumerate(leaves):
        members[i, : len(own)] = own
    away = _to_boxes(qp, low, high)
    order = np.argsort(away, axis=1)
    dist, found = np.full((len(q), keep), np.inf), np.full((len(q), keep), -1)
    active = np.arange(len(q))
    for r in range(len(leaves)):
        leaf = order[active, r]
        go = away[active, leaf] <= limit * np.minimum(bound[active], dist[active, k - 1])
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        number = members[leaf]
        d = 2 - 2 * np.einsum("ad,ald->al", q[active], v[number])
        d = np.where(number < 0, np.inf, np.maximum(d, 0))
        both, names = np.hstack([dist[active], d]), np.hstack([found[active], number])
        best = np.argsort(both, axis=1, kind="stable")[:, :keep]
        dist[active], found[active] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    return dist, found


def _valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("_id"), v.alias("_v")).where("_v IS NOT NULL AND _id IS NOT NULL")
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("_v", lambda x: x != 0))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """Each distinct vector with its `keep` smallest ids; more of them can never be among the nearest."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    for keys in (["_v", "_salt"], ["_v"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_id"))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    return salted.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`query_id`, `rank` (from 1), id, `score`: the k nearest found rows of each query by cosine, the query's own id left out.

    Ties go to the smaller id; with fewer candidates all are returned. Null, zero or non-finite vectors (or with a null
    component), null ids, and vectors whose number of components is not the most frequent one (the larger of equally
    frequent ones) take no part. Of a vector that very many rows share, the smallest ids are found. Repeated rows of one
    id count once. Other columns are not read.
    """
    spark = rows.sparkSession
    candidates, asked = _valid(rows, id_col, vec_col), _valid(queries, id_col, vec_col)
    common = candidates.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    candidates, asked = candidates.where(F.size("_v") == d).distinct(), materialize(asked.where(F.size("_v") == d).distinct(), "queries")
    points = materialize(_distinct(candidates, k + 1), "points")
    n = points.count()

    sample = points.where(F.pmod(F.xxhash64(F.col("_ids")[0]), F.lit(max(n, 1))) < SAMPLE).select("_v").toPandas()["_v"]
    matrix = _projection(d)
    sampled = _unit(np.array(sample.tolist(), float).reshape(-1, d)) @ matrix
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / BLOCK)), int(math.log2(SAMPLE / 8)))) if n > BLOCK else 0
    cells = spark.sparkContext.broadcast(Cells(sampled, depth))

    def in_cell(batches):
        for b in batches:
            at = cells.value.of(_unit(np.array(b.column(0).to_pylist(), float)) @ matrix) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "_cell"])

    points = materialize(points.mapInArrow(in_cell, "_v array<double>, _ids array<bigint>, _cell int"), "cells")
    shared = materialize(asked.groupBy("_v").agg(F.min("_id").alias("_q")), "asked")
    home = shared.mapInArrow(in_cell, "_v array<double>, _q bigint, _cell int").withColumn("_bound", F.lit(float("inf")))
    first = materialize(_in_blocks(materialize(home, "home"), points, k), "first")
    bounds = first.groupBy("_q").agg(F.min("_kth").alias("_kth"))
    known = shared.join(bounds, "_q", "left").select("_v", "_q", F.coalesce("_kth", F.lit(float("inf"))).alias("_kth"))

    limit = chi_square_quantile(SURE)

    def elsewhere(batches):
        for b in batches:
            p = _unit(np.array(b.column(0).to_pylist(), float).reshape(-1, d)) @ matrix
            bound = b.column(2).to_numpy()
            ask = cells.value.distances(p) <= limit * bound[:, None]
            ask[np.arange(len(p)), cells.value.of(p)] = False
            row, cell = np.nonzero(ask)
            took = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(cell, pa.int32()), b.column(2).take(took)], names=["_v", "_q", "_cell", "_bound"])

    rest = materialize(known.mapInArrow(elsewhere, "_v array<double>, _q bigint, _cell int, _bound double"), "elsewhere")
    second = _in_blocks(rest, points, k)

    found = first.unionByName(second).select("_q", F.explode("_ids").alias("_n"), "_score")
    order = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_score"), "_n"))
    best = found.withColumn("_rank", order).where(F.col("_rank") <= k + 1)
    best = best.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("_rank", "_n", "_score"))).alias("_best"))
    named = asked.join(shared.withColumnRenamed("_v", "_w"), F.col("_v") == F.col("_w")).select("_id", "_q")
    own = named.join(materialize(best, "best"), "_q").select("_id", F.slice(F.filter("_best", lambda x: x.getField("_n") != F.col("_id")), 1, k).alias("_best"))
    out = own.select("_id", F.posexplode("_best").alias("_at", "_x"))
    return out.select(F.col("_id").alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x._n").alias(id_col), F.col("_x._score").alias("score"))


def _in_blocks(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Search each query in its `_cell`: `_q`, `_ids` and `_score` of near vectors, `_kth` (squared distance).

    A cell's vectors and its queries are cut into blocks by their counts (a row per cell), and every block of queries
    meets every block of vectors, so a task's work is bounded."""
    parts = {name: {r["_cell"]: max(1, -(-r["count"] // BLOCK)) for r in df.groupBy("_cell").count().collect()} for name, df in (("p", points), ("q", queries))}

    def number(of: str):
        table = F.create_map(*(F.lit(int(x)) for pair in parts[of].items() for x in pair)) if parts[of] else F.create_map().cast("map<int,int>")
        return F.coalesce(table[F.col("_cell")], F.lit(1))

    left = queries.withColumn("_qb", F.pmod(F.xxhash64("_q"), number("q")).cast("int")).withColumn("_pb", F.explode(F.sequence(F.lit(0), number("p") - 1)))
    right = points.withColumn("_pb", F.pmod(F.xxhash64(F.col("_ids")[0]), number("p")).cast("int")).withColumn("_qb", F.explode(F.sequence(F.lit(0), number("q") - 1)))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"_q": [], "_ids": pd.Series([], dtype=object), "_score": [], "_kth": []})
        asked, vectors = np.array(q["_v"].tolist(), float), np.array(p["_v"].tolist(), float)
        dist, found = search(asked, q["_bound"].to_numpy(float), vectors, k + 1)
        row, col = np.nonzero(found >= 0)
        at = found[row, col]
        ids = p["_ids"].to_numpy()
        return pd.DataFrame({"_q": q["_q"].to_numpy()[row], "_ids": ids[at], "_score": _cosines(asked[row], vectors[at]), "_kth": dist[row, k]})

    keys = ["_cell", "_pb", "_qb"]
    both = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return both.applyInPandas(run, "_q bigint, _ids array<bigint>, _score double, _kth double")
