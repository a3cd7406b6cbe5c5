"""Vector columns as numpy blocks, their exact integers, and sums over all rows.

A component's integer is the floor of a multiple of it, taken at
``LARGEST`` where it is beyond. Arithmetic on integers is done in 64 bits where
a bound on the result allows it, and in Python integers elsewhere, so results
are exact whatever the vectors hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import col

#: Products of two such integers, added over 65,536 components, still have 38 digits.
LARGEST = 1 << 55
SAFE = 1 << 62
TOTAL = pa.decimal128(38, 0)


def is_finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is whole; other columns can't clash with an operator's own."""
    vector = col(vec_col).cast("array<double>")
    return rows.select(col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(is_finite(F.col("vector")))


def dimensions(rows: DataFrame) -> int:
    """Components of the longest vector, 0 without rows."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; components that a shorter vector lacks are 0."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def integers(values: np.ndarray, factor: int) -> np.ndarray:
    """Floor of ``factor`` times each value, as 64-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * float(factor)), -LARGEST, LARGEST).astype(np.int64)


def largest(x: np.ndarray) -> int:
    """Largest magnitude in an integer array."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def fitting(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` in 64 bits if results up to ``bound`` fit, else in Python integers."""
    return x if bound < SAFE else x.astype(object)


def longs(values: Iterable) -> pa.Array:
    """Integers as a long column; what a long can't hold is null."""
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def totals(values: Iterable) -> pa.Array:
    """Integers as a column that sums exactly."""
    return pa.array([Decimal(int(v)) for v in values], TOTAL)


def total_of(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of ``read``'s array of doubles; its size is fixed by the vectors' length, not by the rows.

    Every task gives one array, Spark adds them place by place, and the sum is all the driver gets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int64)), pa.array(found.astype(float))],
                                         names=["place", "value"])

    found = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(found, key=lambda r: r["place"])])


def exact_total_of(rows: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], list[int]]) -> list[int]:
    """The same for integers of any size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int64)), totals(found)], names=["place", "value"])

    found = rows.mapInArrow(run, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [int(r["value"]) for r in sorted(found, key=lambda r: r["place"])]
