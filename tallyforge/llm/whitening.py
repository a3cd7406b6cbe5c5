"""Whitening of vectors by a bidiagonal qd solver.

One pass sums the vectors' integers exactly. The next centres them (count times
value less sum, in integers) and reduces blocks of centred rows by QR to one
triangular factor per task; factors are reduced further in groups until one is
left. Its singular values are those of all centred rows. The driver, which
only ever holds that factor (dimensions squared), brings it to bidiagonal form and
takes values by dqds and directions by twisted factorisations (``bidiagonal``).
Every row is then projected on the directions, each divided by the root of
its variance; the covariance of what comes out is measured over all rows.

Defined cases: a vector that is null, or holds a null or non-finite component,
takes no part and has no row; a shorter vector counts as having zeros at its
end. Repeated rows count and come out each time; a row without an id counts and
keeps its null. Components without variance (fewer different rows than
dimensions, constant or dependent dimensions) do not exist: a standard deviation
within 1e-11 of the first one's is rounding. So a table of equal rows, or an
empty one, gives no rows. A deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import vectors as V
from tallyforge.llm.bidiagonal import right_vectors
from tallyforge.session import settle

#: Rows centred and reduced, or projected, at a time.
RUN_ROWS = 2048
#: Factors reduced to one by a task.
FAN_IN = 32
#: Standard deviations below this part of the first are rounding.
ROUNDING = 1e-11


@dataclass(frozen=True)
class Whitening:
    """What the fit found: sums per dimension, and a direction and its variance per component."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray      # falling
    directions: np.ndarray     # dimension by component, unit length
    trace: float               # of the covariance of all dimensions
    factor: int
    shift: int

    def deviations(self, values: np.ndarray) -> np.ndarray:
        """n * x - sum of every component, exact."""
        x = V.integers(values, self.factor)
        if self.shift:
            x = x + self.shift
        bound = self.n * V.largest(x) + max(map(abs, self.sums), default=0)
        return V.fitting(x, bound) * self.n - np.array(self.sums, dtype=np.int64 if bound < V.SAFE else object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ (self.directions / np.sqrt(self.variances))


def _runs(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and values of up to ``RUN_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_ROWS):
            part = batch.slice(at, RUN_ROWS)
            yield part.column(0), V.matrix(part.column(1), dims)


def _triangular(rows: DataFrame, model: Whitening, dims: int) -> np.ndarray:
    """The triangular factor of all centred rows."""
    schema = "no long, factor binary"

    def one(no: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["no", "factor"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for _, values in _runs(batches, dims):
            r = np.linalg.qr(np.vstack([r, model.deviations(values).astype(float) / model.n]), mode="r")
        if len(r):
            yield one(TaskContext.get().partitionId(), r)

    def reduce_factors(found: pa.Table) -> pa.Table:
        stack = [np.frombuffer(f, dtype=float).reshape(-1, dims) for f in found["factor"].to_pylist()]
        return pa.Table.from_batches([one(found["no"][0].as_py() // FAN_IN, np.linalg.qr(np.vstack(stack), mode="r"))])

    factors = settle(rows.mapInArrow(reduce_rows, schema), "factors")
    while (left := factors.agg(F.max("no")).first()[0]) > 0:
        group = F.floor(F.col("no") / FAN_IN)
        factors = settle(factors.groupBy(group.alias("of")).applyInArrow(reduce_factors, schema), "factors")
    return np.frombuffer(factors.first()["factor"], dtype=float).reshape(-1, dims)


def fit(rows: DataFrame, components: int = 32, factor: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
        vec_col: str = "embedding") -> Whitening | None:
    """The whitening of x = floor(factor * component) + shift over all rows; None without rows or without any variance."""
    rows = V.usable(rows, id_col, vec_col)
    dims = V.dimensions(rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> list[int]:
        found, n = np.zeros(dims, dtype=object), 0
        for _, values in _runs(batches, dims):
            x = V.integers(values, factor)
            found = found + V.fitting(x, len(x) * V.largest(x)).sum(axis=0) + shift * len(x)
            n += len(x)
        return [n, *found]

    n, *found = V.exact_total_of(rows, sums) if dims else [0]
    if not n:
        return None
    start = Whitening(n, tuple(found), np.zeros(0), np.zeros((dims, 0)), 0.0, factor, shift)
    r = _triangular(rows, start, dims)
    if len(r) < dims:
        r = np.vstack([r, np.zeros((dims - len(r), dims))])
    squared, directions = right_vectors(r)
    kept = int((squared > squared[0] * ROUNDING ** 2).sum()) if squared[0] > 0 else 0
    kept = min(components, kept)
    if not kept:
        return None
    return Whitening(n, tuple(found), squared[:kept] / n, directions[:, :kept], float(np.square(r).sum()) / n, factor, shift)


def identity_error(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    dims, k = model.directions.shape

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for _, values in _runs(batches, dims):
            w = model.whitened(model.deviations(values))
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        return total.ravel()

    mean, *products = V.total_of(V.usable(rows, id_col, vec_col), moments).reshape(k + 1, k) / model.n
    return float(np.abs(np.array(products) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (sum of squares of n * x - sum) and the whitened vector of every row."""
    dims = len(model.directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _runs(batches, dims):
            d = model.deviations(values)
            exact = V.fitting(d, dims * V.largest(d) ** 2)
            w = model.whitened(d)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([ids, V.longs((exact * exact).sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                                             names=["vec_id", "deviation", "whitened"])

    return V.usable(rows, id_col, vec_col).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def components_of(rows: DataFrame, components: int = 32, factor: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
                  vec_col: str = "embedding") -> DataFrame:
    """A row for every row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(rows, components, factor, shift, id_col, vec_col)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                                     "explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    spread = whiten(rows, model, id_col, vec_col).select("vec_id", "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    return spread.select(
        "vec_id", (F.col("_place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_place")).alias("explained"), F.lit(identity_error(rows, model, id_col, vec_col)).alias("identity_error"))
