"""Exact top-k by inner product: columnar branch and bound.

Vectors lie in blocks in vertical layout, one run of integers per dimension,
the heaviest dimension first. For each query the scores of a block grow by a
group of dimensions at a time. A candidate's score so far and the norms of what
remains of both vectors (their product bounds the remaining inner product)
tell whether it can still be among the best; those that can't leave the list of
survivors, which alone is read in the next group.

Queries and rows meet as blocks in a grid: a cell holds a bounded group of query
blocks and a bounded group of row blocks. A cell keeps the best k of each of its
queries, and a ranking over cells picks the result, so nothing but k rows per
query and cell is shuffled after the grid, and no task holds more than its
cell however many rows there are. Scores are exact integers.

Defined cases: a vector that is null, or holds a null or non-finite component,
takes no part; a shorter vector counts as having zeros at its end, an empty
one as zeros alone. A row is no candidate of a query with its own id. A repeated
row is a candidate each time, and a repeated query is answered each time. A row
without an id is no query; as a candidate it comes after equal scores with ids.
Of equal scores the smaller id is first. A score that a long can't hold is null,
in its right rank. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm import vectors as V
from tallyforge.llm.columns import parts_for
from tallyforge.session import settle

#: Vectors in a block.
BLOCK_ROWS = 4096
#: Queries whose first group of dimensions is multiplied at once.
QUERY_RUN = 128
#: Dimensions added between two looks at the bounds.
GROUP = 8
#: Query and row vectors of a cell at most, but for the last block of each.
CELL_QUERIES = 32_768
CELL_ROWS = 65_536
EXACT_DOUBLE = 1 << 53

BLOCKS = "block long, n int, ids binary, known binary, values binary, width int"
FOUND = "query_no long, query_id long, vec_id long, score decimal(38,0)"


def blocks(rows: DataFrame, factor: int, dims: int, size: int = BLOCK_ROWS) -> DataFrame:
    """The vectors' integers, up to ``size`` of them a row: vertical layout in the narrowest width that holds them."""

    def packed(number: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        width = next(w for w in (2, 4, 8) if V.largest(x) < 1 << (8 * w - 1))
        cells = [number, len(x), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                 np.ascontiguousarray(x.T, dtype=f"<i{width}").tobytes(), width]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)],
                                          names=["block", "n", "ids", "known", "values", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, have = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids.append(part.column(0))
                held.append(V.integers(V.matrix(part.column(1), dims), factor))
                have += part.num_rows
                if have >= size:
                    all_ids, x = pa.concat_arrays(ids), np.concatenate(held)
                    yield packed(number, all_ids[:size], x[:size])
                    number, ids, held, have = number + 1, [all_ids[size:]], [x[size:]], have - size
        if have:
            yield packed(number, pa.concat_arrays(ids), np.concatenate(held))

    return rows.mapInArrow(run, BLOCKS)


def unpacked(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are set, and the vertical values of a block."""
    values = np.frombuffer(row["values"], dtype=f"<i{row['width']}").reshape(dims, row["n"])
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["known"], dtype=bool), values


def _remaining(columns: np.ndarray) -> list[np.ndarray]:
    """Norms over the dimensions from each group on; one more, of zeros, at the end."""
    squares = np.square(columns.astype(float))
    norms = [np.zeros(columns.shape[1])]
    for at in reversed(range(0, len(columns), GROUP)):
        norms.append(norms[-1] + squares[at:at + GROUP].sum(axis=0))
    return [np.sqrt(x) for x in reversed(norms)]


class Best:
    """The best k (score, id) of every query so far."""

    def __init__(self, k: int, queries: int):
        self.k = k
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(queries)]   # (-score, id is null, id)
        self.least = np.full(queries, -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if scores.dtype != object and len(scores) > self.k:
            order = np.lexsort((ids, ~known, -scores))[:self.k]
            scores, ids, known = scores[order], ids[order], known[order]
        new = [(-int(s), not have, int(i)) for s, i, have in zip(scores, ids, known)]
        self.rows[query] = sorted(self.rows[query] + new)[:self.k]
        if len(self.rows[query]) == self.k:
            self.least[query] = -self.rows[query][-1][0]


def search_block(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, known: np.ndarray,
                 values: np.ndarray) -> None:
    """Bring a block (``values``, dimension by row) into the best of ``queries`` (query by dimension)."""
    weight = np.square(values.astype(float)).sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    dims = len(order)
    bound = max(1, dims) * V.largest(values) * V.largest(queries)
    kind = float if bound < EXACT_DOUBLE else np.int64 if bound < V.SAFE else object
    columns, queries = values[order].astype(kind), queries[:, order].astype(kind)
    row_rest, query_rest = _remaining(columns), _remaining(queries.T)
    groups = list(range(0, dims, GROUP))
    # rounding of the bounds stays far below this
    slack = 1 + 1e-9 * query_rest[0] * row_rest[0].max()
    for first in range(0, len(queries), QUERY_RUN):
        run = slice(first, min(first + QUERY_RUN, len(queries)))
        start = queries[run, :GROUP] @ columns[:GROUP] if dims else np.zeros((run.stop - first, len(ids)), dtype=kind)
        reach = start.astype(float, copy=False)
        if len(groups) > 1:
            reach = reach + query_rest[1][run, None] * row_rest[1][None, :]
        alive = reach >= (best.least - slack)[run, None]
        for q in range(first, run.stop):
            left = np.flatnonzero(alive[q - first])
            if not len(left):
                continue
            scores = start[q - first, left]
            for g, at in enumerate(groups[1:], 2):
                scores = scores + queries[q, at:at + GROUP] @ columns[at:at + GROUP].take(left, axis=1)
                can = scores.astype(float, copy=False) + query_rest[g][q] * row_rest[g][left] >= best.least[q] - slack[q]
                if not can.all():
                    left, scores = left[can], scores[can]
                    if not len(left):
                        break
            other = ~known[left] | (ids[left] != query_ids[q])
            if other.any():
                best.add(q, scores[other], ids[left][other], known[left][other])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, factor: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` rows with the largest inner product with each query."""
    spark = rows.sparkSession
    rows, queries = V.usable(rows, id_col, vec_col), V.usable(queries, id_col, vec_col).where("vec_id IS NOT NULL")
    dims = max(V.dimensions(rows), V.dimensions(queries))
    row_blocks = settle(blocks(rows, factor, dims), "row-blocks")
    query_blocks = settle(blocks(queries, factor, dims), "query-blocks")
    n = row_blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
    m = query_blocks.agg(F.sum("n")).first()[0] or 0
    query_groups = parts_for(m, CELL_QUERIES, 1)
    row_groups = parts_for(n[0] or 0, CELL_ROWS, max(1, min(n[1], spark.sparkContext.defaultParallelism)))

    def cell(found_queries: pa.Table, found_rows: pa.Table) -> pa.Table:
        numbers, query_ids, values = [], [], []
        for row in found_queries.to_pylist():
            ids, _, x = unpacked(row, dims)
            numbers.append((row["block"] << 13) + np.arange(row["n"]))
            query_ids.append(ids)
            values.append(x.T.astype(np.int64))
        out: list[tuple] = []
        if numbers and found_rows.num_rows:
            numbers, query_ids, values = (np.concatenate(x) for x in (numbers, query_ids, values))
            best = Best(k, len(numbers))
            for batch in found_rows.to_batches(max_chunksize=1):
                for row in batch.to_pylist():
                    search_block(best, query_ids, values, *unpacked(row, dims))
            out = [(int(no), int(q), None if null else i, -s) for no, q, kept in zip(numbers, query_ids, best.rows)
                   for s, null, i in kept]
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                         V.totals(cols[3])], names=["query_no", "query_id", "vec_id", "score"])

    dealt = lambda groups: F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    all_of = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = query_blocks.select(dealt(query_groups).alias("query_group"), all_of(row_groups).alias("row_group"), *query_blocks.columns)
    right = row_blocks.select(all_of(query_groups).alias("query_group"), dealt(row_groups).alias("row_group"), *row_blocks.columns)
    cells = left.groupBy("query_group", "row_group").cogroup(right.groupBy("query_group", "row_group")).applyInArrow(cell, FOUND)
    by_score = W.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = settle(cells, "cell-best").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
