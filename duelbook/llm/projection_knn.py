"""Nearest neighbours over low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected onto a few Gaussian directions. A Euclidean distance r becomes a projected distance whose square, over
r squared, follows a chi-square law. A kd-tree over the projections hands out vectors in the order of their projected distance;
each is verified on the original vectors. The search stops as soon as a vector that is nearer than the k-th best so far
would have come up already with probability ``sure``.

Vectors are dealt out by a hash of their id to blocks of about ``BLOCK_ROWS``, each with a tree of its own; queries
meet every block in groups of about ``QUERY_ROWS``. Equal vectors of a block are one point of its tree.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS, NEAREST, SURE = 16, 10, 0.9
BLOCK_ROWS, QUERY_ROWS, LEAF = 8192, 4096, 64


def directions(size: int, m: int = DIRECTIONS) -> np.ndarray:
    """The Gaussian directions of all vectors of a size; a 2-stable law."""
    return np.random.default_rng([size, m, 20]).standard_normal((size, m))


def chi_square(x: float, m: int) -> float:
    """Distribution function of the chi-square law with an even number ``m`` of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    if half > 700:
        return 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


class Tree:
    """kd-tree over projected points: median splits on the widest side down to ``leaf`` points, every node with its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.low, self.high, self.below = [], [], []  # of each node: box, then (left, right) or the rows of a leaf
        self.boxes: tuple[np.ndarray, np.ndarray] | None = None
        self._grow(np.arange(len(points)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        here = self.points[rows]
        node = len(self.below)
        self.low.append(here.min(axis=0))
        self.high.append(here.max(axis=0))
        self.below.append(rows)
        if len(rows) > leaf:
            side = int(np.argmax(self.high[node] - self.low[node]))
            middle = len(rows) // 2
            order = np.argpartition(here[:, side], middle)
            self.below[node] = (self._grow(rows[order[:middle]], leaf), self._grow(rows[order[middle:]], leaf))
        return node

    def incremental(self, q: np.ndarray, together: int = 4 * LEAF):
        """Points in the order of their squared projected distances, as (distances, rows) of at most ``together``.

        Best first: the nearest unopened box is opened until it is farther than points that wait; these are then as near as any to come.
        """
        if self.boxes is None:
            self.boxes = np.array(self.low), np.array(self.high)
        apart = np.maximum(np.maximum(self.boxes[0] - q, q - self.boxes[1]), 0)
        bound = (apart**2).sum(axis=1).tolist()
        boxes = [(bound[0], 0)]
        away, waiting = np.empty(0), np.empty(0, np.int64)
        opened: list[tuple[np.ndarray, np.ndarray]] = []  # leaves whose points aren't sorted in yet
        least = math.inf
        while boxes or least < math.inf:
            reach = boxes[0][0] if boxes else math.inf
            if least > reach:
                below = self.below[heapq.heappop(boxes)[1]]
                if isinstance(below, tuple):
                    for node in below:
                        heapq.heappush(boxes, (bound[node], node))
                else:
                    d = ((self.points[below] - q) ** 2).sum(axis=1)
                    opened.append((d, below))
                    least = min(least, float(d.min()))
                continue
            if opened:
                away, waiting = np.concatenate((away, *(d for d, _ in opened))), np.concatenate((waiting, *(rows for _, rows in opened)))
                order = np.argsort(away, kind="stable")
                away, waiting = away[order], waiting[order]
                opened.clear()
            ready = int(np.searchsorted(away, reach, side="right"))
            for at in range(0, ready, together):
                yield away[at:min(ready, at + together)], waiting[at:min(ready, at + together)]
            away, waiting = away[ready:], waiting[ready:]
            least = float(away[0]) if len(away) else math.inf


class Index:
    """The vectors of a block: distinct ones in a tree, each with its ids in rising order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = DIRECTIONS):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        raw = np.ascontiguousarray(vectors + 0.0)  # -0 and 0 are one number
        _, first, same = np.unique(raw.view(f"V{raw.dtype.itemsize * raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.vectors, self.ids = raw[first], ids
        by = np.argsort(same.ravel(), kind="stable")
        self.groups = np.split(by, np.cumsum(np.bincount(same.ravel()))[:-1])
        self.m, self.directions = m, directions(vectors.shape[1], m)
        self.tree = Tree(self.vectors @ self.directions)
        self.verified = 0

    def search(self, query_id: int, q: np.ndarray, k: int = NEAREST, sure: float = SURE) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found, ties to the smaller id; the query's own id takes no part."""
        best = np.empty(0)
        points = np.empty(0, np.int64)
        held = np.empty(0, np.int64)
        for distances, rows in self.tree.incremental(q @ self.directions):
            if held.sum() >= k:
                last = best[np.searchsorted(np.cumsum(held), k)]
                bound = float(distances[0])
                if bound > 0 and (last == 0 or chi_square(bound / last**2, self.m) >= sure):
                    break
            self.verified += len(rows)
            away = np.sqrt(((self.vectors[rows] - q) ** 2).sum(axis=1))
            best, points = np.concatenate((best, away)), np.concatenate((points, rows))
            order = np.argsort(best, kind="stable")[:k + 1]
            best, points = best[order], points[order]
            held = np.array([len(self.groups[p]) - (query_id in self.ids[self.groups[p]] if b == 0 else 0) for b, p in zip(best, points, strict=True)])
        out = []
        for d, p in zip(best.tolist(), points.tolist(), strict=True):
            out += [(d, int(i)) for i in self.ids[self.groups[p][:k + 1]] if i != query_id]
        return sorted(out)[:k]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: no null id, no null, empty or zero vector, only finite components. Of several
    rows with one id, the least vector stands for it."""
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = 100, sure: float = SURE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision) for every id divisible by ``every``.

    Candidates are all usable vectors of the query's size but its own; with fewer than ``k`` of them, all come back. Ties go to the
    smaller id. An empty table gives no rows; other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    n = vectors.count()
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n / every / query_rows))
    sized = rows.withColumn("size", F.size("v"))

    def everywhere(parts: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)

    data = sized.select("size", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), everywhere(groups, "part"), "vec_id", "v")
    asked = sized.where(F.col("vec_id") % every == 0).select("size", everywhere(blocks, "block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"),
                                                             "vec_id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            def matrix(t: pa.Table) -> np.ndarray:
                return t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

            index = Index(left["vec_id"].to_numpy(), matrix(left))
            for q, v in zip(right["vec_id"].to_pylist(), matrix(right), strict=True):
                out += [(q, i, d) for d, i in index.search(q, v, k, sure)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["size", "block", "part"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
