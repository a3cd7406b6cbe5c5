"""Centroid clustering with distances bounded in rotated coordinates.

A rotation to the principal axes of all vectors is found once. Each vector is
stored with its leading rotated coordinates and the norm of the rest. The
distance of the leading parts squared, plus the squared difference of the two
norms, is a lower bound of a squared distance. In a round each vector is
measured, in exact integers, against the centroid with the least bound, and then
only against those whose bound does not exceed what it has found. Tasks send
sums and counts per centroid; the driver gets centroids times dimensions numbers.

Defined cases: vectors that are null, hold a null or non-finite component or
have another length than ``dims`` take no part and have no row. Repeated rows
count each time; a row without an id takes part and starts as a centroid only
after all others, and equal ids start in the order of their vectors. Fewer vectors than
centroids start fewer centroids; an empty table gives no rows. A distance or sum
that a long can't hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import vectors as V
from tallyforge.session import settle

#: Leading rotated coordinates kept of each vector.
LEADING = 16
RUN_ROWS = 4096
ASSIGNED = "vec_id long, cluster int, distance decimal(38,0)"


class Rotation:
    """Principal axes of all vectors, and what is kept of a vector in them."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def kept(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, norm of the rest, and squared norm of the centred vector."""
        centred = x.astype(float) - self.mean
        leading = centred @ self.axes
        return leading, np.linalg.norm(centred - leading @ self.axes.T, axis=1), np.square(centred).sum(axis=1)


def principal_rotation(rows: DataFrame, dims: int, factor: int, leading: int) -> Rotation:
    """Axes of the largest variance over all rows (vec_id, vector), by sums of products."""
    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, dims + 1))
            x[:, 1:] = V.integers(V.matrix(batch.column(1), dims), factor)
            total += x.T @ x
        return total.ravel()

    total = V.total_of(rows, moments).reshape(dims + 1, dims + 1)
    mean = total[0, 1:] / total[0, 0]
    return Rotation(mean, np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :leading])


def rotated(rows: DataFrame, rotation: Rotation, dims: int, factor: int) -> DataFrame:
    """vec_id, the vector's integers, leading coordinates, residual norm and squared norm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.integers(V.matrix(batch.column(1), dims), factor)
            leading, residual, squared = rotation.kept(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                     for a in (x, leading)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(residual), pa.array(squared)],
                                             names=["vec_id", "x", "leading", "residual", "squared"])

    return rows.mapInArrow(run, "vec_id long, x array<long>, leading array<double>, residual double, squared double")


def squared_distance(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of rows to a centroid."""
    bound = V.largest(x) + max(map(abs, centroid))
    d = V.fitting(x, bound * bound * x.shape[1]) - np.array(centroid, dtype=np.int64 if bound * bound * x.shape[1] < V.SAFE else object)
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, leading: np.ndarray, residual: np.ndarray, squared: np.ndarray, centroids: list[list[int]],
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, the smaller number on ties, its squared distance, and how many distances were measured."""
    c_leading, c_residual, c_squared = rotation.kept(np.array(centroids, dtype=object))
    bounds = np.square(leading[:, None, :] - c_leading).sum(axis=2) + np.square(residual[:, None] - c_residual)
    # rounding stays far below this
    bounds -= 1 + 1e-9 * (squared[:, None] + c_squared) + 1e-12 * float(np.square(rotation.mean).sum())
    cluster = bounds.argmin(axis=1)
    apart = V.largest(x) + max(abs(v) for c in centroids for v in c)
    distance = V.fitting(np.zeros(len(x), dtype=np.int64), apart * apart * x.shape[1])
    measured = len(x)
    for c, centroid in enumerate(centroids):
        mine = np.flatnonzero(cluster == c)
        if len(mine):
            distance[mine] = squared_distance(x[mine], centroid)
    for c, centroid in enumerate(centroids):
        near = np.flatnonzero((bounds[:, c] <= distance.astype(float)) & (cluster != c))
        if not len(near):
            continue
        measured += len(near)
        d = squared_distance(x[near], centroid)
        better = (d < distance[near]) | ((d == distance[near]) & (c < cluster[near]))
        distance[near[better]] = d[better]
        cluster[near[better]] = c
    return cluster, distance, measured


def _runs(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_ROWS):
            part = batch.slice(at, RUN_ROWS)
            lists = [part.column(i).flatten().to_numpy().reshape(part.num_rows, -1) for i in (1, 2)]
            yield part.column(0), *lists, part.column(3).to_numpy(), part.column(4).to_numpy()


def _moved(rows: DataFrame, centroids: list[list[int]], rotation: Rotation, dims: int) -> list[list[int]]:
    """The centroids after one round."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> list[int]:
        total = np.zeros((k, dims + 1), dtype=object)
        for _, x, *kept in _runs(batches, dims):
            cluster, _, _ = nearest(x, *kept, centroids, rotation)
            exact = V.fitting(x, len(x) * V.largest(x))
            for c in range(k):
                mine = exact[cluster == c]
                if len(mine):
                    total[c, 0] += len(mine)
                    total[c, 1:] += mine.sum(axis=0)
        return list(total.ravel())

    total = np.array(V.exact_total_of(rows, sums), dtype=object).reshape(k, dims + 1)
    return [[s // t[0] for s in t[1:]] if t[0] else c for t, c in zip(total, centroids)]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, factor: int = 1024, dims: int = 64, seed: str = "3:",
            leading: int = LEADING, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector after ``rounds``, and the final centroids.

    The first centroids are the ``k`` vectors whose id behind ``seed`` has the smallest SHA-256.
    """
    rows = V.usable(rows, id_col, vec_col).where(F.size("vector") == dims)
    by_hash = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = rows.orderBy(F.asc_nulls_last(by_hash), "vector").limit(k).collect()
    centroids = [[int(v) for v in V.integers(np.array(r["vector"], dtype=float), factor)] for r in starts]
    if not centroids:
        return rows.sparkSession.createDataFrame([], ASSIGNED), []
    rotation = principal_rotation(rows, dims, factor, min(leading, dims))
    stored = settle(rotated(rows, rotation, dims, factor), "rotated")
    for _ in range(rounds):
        centroids = _moved(stored, centroids, rotation, dims)
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, *kept in _runs(batches, dims):
            found, distance, _ = nearest(x, *kept, final, rotation)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), V.totals(distance)],
                                             names=["vec_id", "cluster", "distance"])

    return settle(stored.mapInArrow(assign, ASSIGNED), "assigned"), final


def inertias(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assigned rows with their cluster's and the whole inertia and their centroid's digest."""
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    number = lambda v: F.lit(v).try_cast("long")
    per_cluster = F.array(*[number(sums.get(c)) for c in range(len(centroids))] or [F.lit(None).cast("long")])
    digests = F.array(*[F.lit(digest(c)) for c in centroids] or [F.lit(None).cast("string")])
    return assigned.select(
        "vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"),
        F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        number(sum(sums.values()) if sums else None).alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"))
