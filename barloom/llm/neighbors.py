"""Nearest neighbours by cosine over low-dimensional stable projections.

Unit vectors are projected to ``M`` Gaussian (2-stable) coordinates, in which a
kd-tree is laid over all rows: its upper part (fitted on a bounded sample of
projected points) deals the rows to cells, its lower part is built in each cell.
A query visits projected neighbours in order of their projected distance and
verifies them with the original vectors. It stops when the chi-square test
holds: the squared ratio of projected to true distance follows a chi-square law
with M degrees of freedom, so beyond r = d_k * sqrt(quantile(P)) a vector nearer
than the current k-th distance d_k remains with a probability below 1 - P.

Across cells this takes two rounds: the home cell gives a first d_k, then the
query goes to every cell whose box reaches into the ball of radius r.

Equal vectors are indexed once with their k + 1 smallest ids (no other can be
among the k nearest), and equal queries are searched once, so a vector that a
third of all rows share costs one point. Cells are streamed: a task holds one
cell and a batch of queries.

Edge cases: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part; vectors may be of any size, the
least and the greatest doubles included; with fewer candidates than k
all are returned; ties go to the smaller id; an empty table gives no rows; other
columns may have any name. Rows that repeat an id are one row if their vectors
are equal; of an id with several vectors each is a point and a query of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, table

#: Projected coordinates; even, so that the chi-square law has a closed form.
M = 8
#: Confidence of the stopping test.
P = 0.95
#: Points of a cell, about.
CELL = 8192
LEAF = 256
#: Projected points that the upper tree is fitted on, at most.
SAMPLE = 20_000
MAX_CELLS = 65_536


def chi_square(x: float, m: int = M) -> float:
    """Distribution function for even ``m``."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def quantile(p: float, m: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def directions(dim: int, m: int = M, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Tree:
    """The upper kd-tree: medians of a sample; a point's path of comparisons is its cell."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.m = depth, points.shape[1]
        self.dim = np.zeros(max((1 << depth) - 1, 0), np.int64)
        self.value = np.zeros(len(self.dim))
        groups = {0: points}
        for node in range(len(self.dim)):
            p = groups.pop(node, points[:0])
            if len(p):
                self.dim[node] = int(np.argmax(p.max(0) - p.min(0)))
                self.value[node] = np.median(p[:, self.dim[node]])
            right = p[:, self.dim[node]] > self.value[node]
            groups[2 * node + 1], groups[2 * node + 2] = p[~right], p[right]

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.dim[node]] > self.value[node])
        return node - len(self.dim)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full((1, self.m), -np.inf), np.full((1, self.m), np.inf)
        for d in range(self.depth):
            first = (1 << d) - 1
            low, high = np.repeat(lo, 2, 0), np.repeat(hi, 2, 0)
            for i in range(1 << d):
                a, v = self.dim[first + i], self.value[first + i]
                high[2 * i, a], low[2 * i + 1, a] = min(high[2 * i, a], v), max(low[2 * i + 1, a], v)
            lo, hi = low, high
        return lo, hi


def box_distance(lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(np.maximum(lo - q, q - hi), 0) ** 2).sum(1))


class Cell:
    """The lower kd-tree of one cell: leaves with tight boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            p = projected[at]
            a = int(np.argmax(p.max(0) - p.min(0)))
            order = np.argpartition(p[:, a], len(at) // 2)
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        self.leaves = [(ids[a], vectors[a], projected[a], np.sqrt((vectors[a] ** 2).sum(1))) for a in leaves]
        self.lo = np.array([p.min(0) for _, _, p, _ in self.leaves])
        self.hi = np.array([p.max(0) for _, _, p, _ in self.leaves])

    def search(self, v: np.ndarray, q: np.ndarray, k: int, d_k: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best k of the cell, visited until the test holds."""
        norm = math.sqrt((v**2).sum())
        ids, scores = np.empty(0, np.int64), np.empty(0)
        reach = box_distance(self.lo, self.hi, q)
        for i in np.argsort(reach):
            if reach[i] > d_k * ratio:
                break
            own, vectors, projected, norms = self.leaves[i]
            near = np.sqrt(((projected - q) ** 2).sum(1)) <= d_k * ratio
            if not near.any():
                continue
            cos = (vectors[near] * v).sum(1) / (norms[near] * norm)
            ids, scores = np.concatenate([ids, own[near]]), np.concatenate([scores, cos])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                d_k = min(d_k, math.sqrt(max(0.0, 2 - 2 * scores.min())))
        return ids, scores


def _matrix(s: pd.Series) -> np.ndarray:
    """Vectors as rows, each times the power of two that brings its largest component to about one.

    No cosine changes by that, not in its last bit, and no square runs over or vanishes, whatever a vector's size.
    """
    v = np.array(s.tolist(), np.float64).reshape(len(s), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if v.size else v


def _project(v: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v**2).sum(1, keepdims=True))) @ d


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    p: float = P,
    cell: int = CELL,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, id, score) of each query's k nearest; ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = slim.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))
    sizes = slim.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head()
    empty = spark.range(0).select(
        F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")
    )
    if not sizes:
        return empty
    dim = sizes["dim"]
    slim = slim.where(F.size("v") == dim)
    # -0.0 and 0.0 are the same number
    slim = slim.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    by = Window.partitionBy("v").orderBy("id")
    kept = slim.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    points = kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = materialize(points.select(F.col("ids")[0].alias("uid"), "ids", "v"), "points")
    queries = slim.where(is_query).select("v", F.col("id").alias("query_id"))
    # each query id with the point that is its vector
    owners = materialize(points.select("uid", "v").join(queries, "v").select("uid", "query_id"), "queries")
    asked = points.join(owners.select("uid").distinct(), "uid", "left_semi").select("uid", "v")

    total = points.count()
    depth = min(max(0, math.ceil(math.log2(max(total, 1) / cell))), int(math.log2(MAX_CELLS)))
    d = directions(dim)
    tree = Tree(np.empty((0, M)), 0)
    if depth:
        span = 1 << 30
        some = points.where(F.pmod(F.xxhash64("uid"), F.lit(span)) < int(min(1.0, sample / total) * span)).select("v")
        tree = Tree(_project(_matrix(some.toArrow()["v"].to_pandas()), d), depth)
    lo, hi = tree.boxes()
    ratio = math.sqrt(quantile(p))
    held = spark.sparkContext.broadcast((d, tree, lo, hi))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, tree, _, _ = held.value
        for b in batches:
            if len(b):
                yield b.assign(cell=tree.cells(_project(_matrix(b["v"]), d)))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells, other than the home cell, that the stopping ball touches."""
        d, tree, lo, hi = held.value
        for b in batches:
            if not len(b):
                continue
            q = _project(_matrix(b["v"]), d)
            home = tree.cells(q)
            for i, (uid, v, d_k) in enumerate(zip(b["uid"], b["v"], b["d_k"])):
                cells = np.flatnonzero(box_distance(lo, hi, q[i]) <= d_k * ratio)
                cells = cells[cells != home[i]]
                if len(cells):
                    yield pd.DataFrame({"cell": cells, "uid": uid, "v": [v] * len(cells), "d_k": d_k})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by cell, its points (kind 0) before its queries (kind 1)."""
        d = held.value[0]
        at, parts, ready = None, [], None
        for b in batches:
            for (c, kind), rows in b.groupby(["cell", "kind"], sort=True):
                if c != at:
                    at, parts, ready = c, [], None
                if kind == 0:
                    parts.append((rows["uid"].to_numpy(), _matrix(rows["v"])))
                    continue
                if not parts and ready is None:
                    continue
                if ready is None:
                    v = np.concatenate([x[1] for x in parts])
                    ready, parts = Cell(np.concatenate([x[0] for x in parts]), v, _project(v, d)), []
                qv = _matrix(rows["v"])
                out = []
                for uid, v, q, d_k in zip(rows["uid"], qv, _project(qv, d), rows["d_k"]):
                    ids, scores = ready.search(v, q, k + 1, d_k, ratio)
                    out.append(pd.DataFrame({"uid": uid, "near": ids, "score": scores}))
                yield pd.concat(out)

    def run(asked: DataFrame) -> DataFrame:
        rows = placed.select("cell", F.lit(0).alias("kind"), "uid", "v", F.lit(9.0).alias("d_k")).unionByName(
            asked.select("cell", F.lit(1).alias("kind"), "uid", "v", "d_k")
        )
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        rows = rows.repartition(width, "cell").sortWithinPartitions("cell", "kind")
        return rows.mapInPandas(search, "uid long, near long, score double")

    placed = points.select("uid", "v").mapInPandas(place, "uid long, v array<double>, cell long")
    home = asked.mapInPandas(place, "uid long, v array<double>, cell long").withColumn("d_k", F.lit(9.0))
    first = materialize(run(home), "home")
    bound = first.groupBy("uid").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    d_k = F.when(F.col("n") > k, F.sqrt(F.greatest(2 - 2 * F.col("low"), F.lit(0.0)))).otherwise(F.lit(9.0))
    further = asked.join(bound, "uid", "left").select("uid", "v", F.coalesce(d_k, F.lit(9.0)).alias("d_k"))
    found = first
    if depth:
        found = first.unionByName(run(further.mapInPandas(reach, "cell long, uid long, v array<double>, d_k double")))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "near")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("uid", "near", "score")
    # points to ids again, then each query without itself
    ids = found.join(points.select(F.col("uid").alias("near"), "ids"), "near").select("uid", "score", F.explode("ids").alias(id_col))
    gathered = ids.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col(id_col)))).alias("all"))
    each = owners.join(gathered, "uid").select(
        "query_id", F.posexplode(F.slice(F.filter("all", lambda x: x[id_col] != F.col("query_id")), 1, k)).alias("at", "x")
    )
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col(f"x.{id_col}").alias(id_col), (-F.col("x.far")).alias("score"))


def op5_srs_neighbors(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
