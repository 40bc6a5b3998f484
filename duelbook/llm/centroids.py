"""Centroid clustering with ns-bounds, in exact integers.

Every vector keeps, for each centroid, the squared distance it last evaluated and the round it did so. All centroids of all
rounds are retained, so a stored distance is loosened by the norm of the centroid's total displacement since that round; the
displacements of single rounds are never summed, and centroids that wander back cost nothing. A centroid is evaluated anew only
where the loosened bound doesn't rule it out, and decisions are made on exact distances. Means move by the sums of the vectors that changed
their cluster, so a settled vector is not read for them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook.llm.common import cut, release, tidy

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components are below this in size, so that squared distances fit 63 bits.
LARGEST = 1 << 27
#: Bounds are widened by this share, far above what a square root in double precision is off by.
_SLACK = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, before int, distances array<bigint>, rounds array<int>, evaluated int"


def integer_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of vectors with ``size`` components, none null, not finite, or LARGEST and beyond after scaling."""
    x = vectors[vector_col]
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fits = F.forall(x, lambda c: F.coalesce(F.abs(F.lit(scale) * c.cast("double")) < LARGEST, F.lit(False)))
    return vectors.where((F.size(x) == size) & fits).select(vectors[id_col].cast("long").alias("vec_id"), whole.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least hashes of their ids, in that order; a null id hashes as an empty one, equal ids go by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(h, "v").limit(clusters).select("v").collect()  # a stated number of rows
    return np.array([r["v"] for r in first], np.int64)


def _grid(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def displaced(history: np.ndarray) -> np.ndarray:
    """(round, centroid): no less than the norm of the way from where a centroid was in that round to where it is in the last."""
    way = history[-1][None] - history
    return np.sqrt((way * way).sum(axis=2).astype(np.float64)) * (1 + _SLACK)


def reassign(v: np.ndarray, cluster: np.ndarray, distances: np.ndarray, rounds: np.ndarray, history: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Nearest centroids of the last round; ``distances`` and ``rounds`` are brought up to date in place where something was evaluated."""
    now, (n, k) = len(history) - 1, distances.shape
    rows, of = np.arange(n), np.arange(k)
    loosened = moved[rounds, of]
    root = np.sqrt(distances.astype(np.float64))
    lower = root * (1 - _SLACK) - loosened
    upper = root[rows, cluster] * (1 + _SLACK) + loosened[rows, cluster]
    lower[rows, cluster] = np.inf
    evaluated = np.zeros(n, np.int32)
    unsure = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    if not len(unsure):
        return cluster, evaluated
    own = cluster[unsure]
    exact = _squared(v[unsure], history[-1][own])
    distances[unsure, own], rounds[unsure, own], evaluated[unsure] = exact, now, 1
    upper = np.sqrt(exact.astype(np.float64)) * (1 + _SLACK)
    at, other = np.nonzero(lower[unsure] <= upper[:, None])
    vector = unsure[at]
    distances[vector, other] = _squared(v[vector], history[-1][other])
    rounds[vector, other] = now
    np.add.at(evaluated, vector, 1)
    # all others are farther than the own one, whatever they are
    known = np.where(rounds[unsure] == now, distances[unsure], np.iinfo(np.int64).max)
    cluster = cluster.copy()
    cluster[unsure] = known.argmin(axis=1)
    return cluster, evaluated


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    way = v - c
    return (way * way).sum(axis=1)


def _start(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        for b in batches:
            v = _grid(b.column(1), size).astype(np.int64)
            distances = np.stack([_squared(v, c) for c in centroids], axis=1) if len(v) else np.empty((0, k), np.int64)
            yield _batch(b.column(0), b.column(1), distances.argmin(axis=1), np.full(len(v), -1), distances, np.zeros((len(v), k), np.int32), np.full(len(v), k))

    return vectors.mapInArrow(tidy(run), _STATE)


def _batch(vec_id, v, cluster, before, distances, rounds, evaluated) -> pa.RecordBatch:
    k = distances.shape[1]
    offsets = np.arange(len(cluster) + 1, dtype=np.int32) * k
    return pa.RecordBatch.from_arrays(
        [vec_id, v, pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(distances.ravel())),
         pa.ListArray.from_arrays(offsets, pa.array(rounds.astype(np.int32).ravel())), pa.array(evaluated.astype(np.int32))],
        ["vec_id", "v", "cluster", "before", "distances", "rounds", "evaluated"])


def _again(state: DataFrame, history: np.ndarray) -> DataFrame:
    moved = displaced(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = history.shape[1:]
        for b in batches:
            v, before = _grid(b.column("v"), size).astype(np.int64), b.column("cluster").to_numpy()
            distances, rounds = _grid(b.column("distances"), k).copy(), _grid(b.column("rounds"), k).copy()
            cluster, evaluated = reassign(v, before, distances, rounds, history, moved)
            yield _batch(b.column("vec_id"), b.column("v"), cluster, before, distances, rounds, evaluated)

    return state.mapInArrow(tidy(run), _STATE)


def _changes(state: DataFrame, clusters: int, size: int) -> np.ndarray:
    """What the vectors that changed their cluster add to each cluster's sums and, last, count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, size + 1), np.int64)
        for b in batches:
            v = np.column_stack([_grid(b.column("v"), size).astype(np.int64), np.ones(len(b), np.int64)])
            for column, sign in (("cluster", 1), ("before", -1)):
                c = b.column(column).to_numpy()
                for j in np.unique(c[c >= 0]):
                    sums[j] += sign * v[c == j].sum(axis=0)
        at, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[at, place])], ["cluster", "place", "sum"])

    partial = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(tidy(run), "cluster int, place int, sum long")
    change = np.zeros((clusters, size + 1), object)
    for r in partial.groupBy("cluster", "place").agg(F.sum("sum").alias("sum")).collect():  # clusters times components
        change[r["cluster"], r["place"]] = r["sum"]
    return change


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, evaluated of every vector that takes part; the final centroids as integers).

    Vectors that are null, of another length, hold null or non-finite components, or components of LARGEST / scale and beyond, take no part.
    Ties go to the smaller cluster number; equal vectors (repeated rows too) go to the same one. Fewer vectors than clusters give
    that many clusters; without any, no rows. ``evaluated``: distances that the last round computed for the row. Other
    columns are not read. ``distance`` is the exact square.
    """
    whole = integer_vectors(vectors, size, scale, id_col, vector_col)
    history = first_centroids(whole, clusters, seed)[None]
    if not history.size:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("evaluated")).where("false"), history[0]
    k = history.shape[1]
    state = cut(_start(whole, history[0]))
    total = np.zeros((k, size + 1), object)
    for _ in range(rounds):
        change = _changes(state, k, size)
        total = total + change
        means = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else list(old) for t, old in zip(total, history[-1], strict=True)], np.int64)
        history = np.concatenate([history, means[None]])
        if (history[-1] == history[-2]).all():
            break  # no later round can differ
        after = cut(_again(state, history))
        release(state)
        state = after
    final = history[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("cluster").to_numpy()
            distance = _squared(_grid(b.column("v"), size).astype(np.int64), final[c])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(distance), b.column("evaluated")], ["vec_id", "cluster", "distance", "evaluated"])

    assigned = cut(state.select("vec_id", "v", "cluster", "evaluated").mapInArrow(tidy(run), "vec_id long, cluster int, distance long, evaluated int"))
    release(state)
    return assigned, final


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with the distances summed over their cluster and over all, and a digest of their final centroid."""
    spark = assigned.sparkSession
    text = spark.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())], "cluster int, components string")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    fit = lambda c: F.expr(f"try_cast({c} as bigint)")  # noqa: E731 - a sum beyond a long is null
    per = sums.join(text, "cluster").select("cluster", "s", F.sha2("components", 256).alias("centroid_sha256"))
    per = per.withColumn("total", F.sum("s").over(Window.partitionBy(F.lit(0))))  # a row per cluster
    return assigned.join(per, "cluster").select("vec_id", "cluster", "distance", fit("s").alias("cluster_inertia"), fit("total").alias("inertia"), "centroid_sha256")
