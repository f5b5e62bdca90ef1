"""Approximate nearest neighbours by a block matrix join in int8 with error bounds.

Each vector is quantised to int8 by a scale of its own, and the length of what quantisation lost is kept. A tile
multiplies the int8 matrices of a query block and a block of rows; with the kept lengths each product has a bound
for its error. A pair survives if its upper bound reaches the k-th best lower bound of its query. Survivors are
recomputed in double precision from the original vectors and merged into a heap per query.

Because the bounds are honest nothing true is lost: recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.llm.vectors import (
    BLOCK_ROWS,
    QUERY_ROWS,
    best,
    dimension,
    few_rows_per_batch,
    pack,
    rows_of,
    tiles,
    unpack,
    usable,
)
from prumo.session import materialize

FOUND = "query_row long, query_id long, vec_id long, row long, score double"


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the rows they stand for, and the lengths of what they lost."""
    scale = np.abs(matrix).max(axis=1, initial=0.0) / 127
    scale[scale == 0] = 1.0
    rows = np.rint(matrix / scale[:, None]).astype(np.int8)
    stands = rows * scale[:, None]
    return rows, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(matrix - stands, axis=1)


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, components added in order."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += left[:, i] * right[:, i]
    return total


class Heaps:
    """The k best rows of each query so far: the worst of them on top."""

    def __init__(self, k: int):
        self.k = k
        self.heaps: dict[tuple[int, int], list[tuple[float, int, int]]] = {}

    def offer(self, query: tuple[int, int], rows: list[tuple[float, int, int]]) -> None:
        heap = self.heaps.setdefault(query, [])
        for entry in rows:  # (score, -id, -row): the larger the better
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def floor(self, query: tuple[int, int]) -> float:
        heap = self.heaps.get(query, ())
        return heap[0][0] if len(heap) == self.k else -np.inf

    def batch(self, score_type: pa.DataType) -> pa.RecordBatch:
        rows = [(q[0], q[1], -i, -r, s) for q, heap in self.heaps.items() for s, i, r in heap]
        types = [pa.int64()] * 4 + [score_type]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "row", "score"])


def search_tile(queries: tuple, rows: tuple, k: int, heaps: Heaps) -> None:
    """Offer what may be among the k best of each query in this tile."""
    (q_ids, q_rows, q), (ids, numbers, x) = queries, rows
    a, a_scale, a_length, a_lost = quantised(q)
    b, b_scale, b_length, b_lost = quantised(x)
    # Sums of products of int8 are whole numbers below 2^24 up to a thousand components: exact in single precision.
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    about = (a.astype(exact) @ b.astype(exact).T) * a_scale[:, None] * b_scale
    bound = np.outer(a_length, b_lost) + np.outer(a_lost, b_length + b_lost)
    bound += 1e-6 * (np.outer(a_length + a_lost, b_length + b_lost) + 1e-30)  # for rounding here
    about[q_rows[:, None] == numbers] = -np.inf  # a query does not meet its own row
    low = about - bound
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q), -np.inf)
    floors = np.array([heaps.floor((r, i)) for r, i in zip(q_rows.tolist(), q_ids.tolist())])
    here, there = np.nonzero((about + bound >= np.maximum(kth, floors)[:, None]) & (about > -np.inf))
    scores = inner(q[here], x[there])
    starts = np.searchsorted(here, np.arange(len(q) + 1))
    for i in range(len(q)):
        part = slice(starts[i], starts[i + 1])
        entries = zip(scores[part].tolist(), (-ids[there[part]]).tolist(), (-numbers[there[part]]).tolist())
        heaps.offer((int(q_rows[i]), int(q_ids[i])), list(entries))


def nearest(
    df: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k rows of largest inner product.

    All other rows are candidates, also those with the query's id; ties go to the smaller id, and equal rows stand side by
    side. Vectors null, zero or with null or non-finite components, and rows with a null id, take no part; shorter vectors count as
    ending in zeros. With fewer than k candidates all are returned. Other columns are not read, so they cannot clash.
    """
    rows = rows_of(df, id_col, vector_col, queries, lambda v: usable(v) & F.exists(v, lambda x: x != 0))
    dim = dimension(rows)
    asked = pack(rows.filter("asked"), QUERY_ROWS, dim)
    paired = tiles(asked, pack(rows, BLOCK_ROWS, dim))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, held = Heaps(k), 0
        for batch in batches:
            for tile in batch.to_pylist():
                asked_for = unpack(tile["q_ids"], tile["q_rows"], tile["q_matrix"], dim)
                search_tile(asked_for, unpack(tile["ids"], tile["rows"], tile["matrix"], dim), k, heaps)
                held += 1
            if held >= 64:  # so that a task holds the heaps of a few query blocks only
                yield heaps.batch(pa.float64())
                heaps, held = Heaps(k), 0
        yield heaps.batch(pa.float64())

    columns = ["q_ids", "q_rows", "q_matrix", "ids", "rows", "matrix"]
    with few_rows_per_batch(df.sparkSession):
        found = materialize(paired.select(*columns).mapInArrow(search, FOUND), "found")
    return best(found, k)

