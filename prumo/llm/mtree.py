"""Exact top-k by inner product with M-trees.

The largest inner product is the smallest Euclidean distance once every row gets one more component that brings all rows of a
tree to one length (and a query a zero there), so a metric tree can search for it.

Each block of rows is an M-tree of pages. An entry of an inner page has a routing row, the radius that covers everything
below, the distance to its parent's routing row, and the page it leads to; an entry of a leaf has a row and that distance. A search takes
pages best first by the least distance anything below can have. Before a distance is worked out, the triangle inequality on the
stored parent distance may already show that the entry is too far. Leaf entries that remain get their whole-number score.

The rows are in blocks, so there is a tree per block; each query block is searched in every tree, starting from
the k best it has in the trees seen so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prumo.llm.blockjoin import Heaps
from prumo.llm.vectors import (
    BLOCK,
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

PAGE = 256  # entries of a page
GROUP = 128  # queries that go through a tree together
FOUND = "query_row long, query_id long, vec_id long, row long, score long"


@dataclass
class Tree:
    """Pages over rows in page order: page i holds entries first[i] … first[i+1]; `leads` is an entry's page, -1 in a leaf."""

    first: np.ndarray
    point: np.ndarray  # number of the entry's row
    radius: np.ndarray
    to_parent: np.ndarray
    leads: np.ndarray


def lifted(matrix: np.ndarray) -> np.ndarray:
    """Rows with the component that brings them all to the length of the longest."""
    squares = (matrix * matrix).sum(axis=1)
    return np.c_[matrix, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))]


def build(points: np.ndarray) -> Tree:
    """Bulk load: rows are split around routing rows taken far from one another until a page holds them."""
    first, point, radius, to_parent, leads = [], [], [], [], []

    def distances(rows: np.ndarray, routing: int) -> np.ndarray:
        return np.sqrt(((points[rows] - points[routing]) ** 2).sum(axis=1))

    def page(rows: np.ndarray, parent: int | None) -> int:
        number = len(first)
        first.append(None)
        if len(rows) <= PAGE:
            gap = distances(rows, parent) if parent is not None else np.zeros(len(rows))
            entries = [(int(r), 0.0, float(g), -1) for r, g in zip(rows, gap)]
        else:
            ways = min(PAGE, -(-len(rows) // (PAGE // 2)))
            chosen = [int(rows[0])]
            nearest = distances(rows, chosen[0])
            owner = np.zeros(len(rows), dtype=np.int64)
            while len(chosen) < ways and nearest.max() > 0:
                chosen.append(int(rows[nearest.argmax()]))
                gap = distances(rows, chosen[-1])
                owner[gap < nearest] = len(chosen) - 1
                nearest = np.minimum(nearest, gap)
            if len(chosen) == 1:  # equal rows: cut anywhere
                owner = np.arange(len(rows)) // PAGE
                chosen = [chosen[0]] * (int(owner.max()) + 1)
            entries = []
            for way, routing in enumerate(chosen):
                below = rows[owner == way]
                if len(below):
                    reach = float(distances(below, routing).max())
                    gap = float(distances(np.array([routing]), parent)[0]) if parent is not None else 0.0
                    entries.append((routing, reach, gap, page(below, routing)))
        first[number] = entries
        return number

    if len(points):
        page(np.arange(len(points)), None)
    for entries in first:
        for a, b, c, d in entries:
            point.append(a), radius.append(b), to_parent.append(c), leads.append(d)
    starts = np.cumsum([0, *map(len, first)])
    return Tree(starts, np.array(point, np.int64), np.array(radius), np.array(to_parent), np.array(leads, np.int64))


def search(
    tree: Tree, entries: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query number, row number) of what may be among the k of largest inner product with each query, its row `own` aside.

    A group of queries goes through the tree together, pages by the least bound that any of them has; a query
    looks into a page only while its own bound allows. entries: the routing rows and rows of all pages in page order, so that a
    page is one stretch of memory. floor: inner products below which nothing is wanted.
    """
    width = queries.shape[1]  # the added component of a query is 0
    base = (queries * queries).sum(axis=1) + float(entries[0] @ entries[0])  # |q|² and the common length of all rows
    slack = 1e-9 * (base + 1.0)
    edge = np.sqrt(slack)
    furthest = np.where(np.isfinite(floor), base - 2 * floor, np.inf)  # squared
    worst = np.full((len(queries), k), np.inf)  # the k least squared distances
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = [(0.0, 0, np.zeros(len(queries)), None)]
    while waiting:
        least, page, bounds, gaps = heapq.heappop(waiting)
        reach = np.sqrt(np.maximum(furthest, 0.0)) + edge
        if least > reach.max():
            break
        asks = np.flatnonzero(bounds <= reach)
        if not len(asks):
            continue
        here = np.arange(tree.first[page], tree.first[page + 1])
        possible = np.ones((len(asks), len(here)), dtype=bool)
        if gaps is not None:  # the triangle inequality on stored distances, before any distance is worked out
            away = np.abs(gaps[asks, None] - tree.to_parent[here])
            possible = away <= reach[asks, None] + tree.radius[here]
            some = possible.any(axis=0)
            here, possible = here[some], possible[:, some]
        squares = base[asks, None] - 2 * (queries[asks] @ entries[here, :width].T)
        if tree.leads[tree.first[page]] >= 0:
            beyond = np.where(possible, np.sqrt(np.maximum(squares, 0.0)), np.inf)
            for i, entry in enumerate(here.tolist()):
                below = np.full(len(queries), np.inf)
                below[asks] = np.maximum(beyond[:, i] - tree.radius[entry] - edge[asks], bounds[asks])
                apart = np.zeros(len(queries))
                apart[asks] = beyond[:, i]
                heapq.heappush(waiting, (float(below.min()), int(tree.leads[entry]), below, apart))
            continue
        rows = tree.point[here]
        near = possible & (squares <= (furthest + slack)[asks, None]) & (rows != own[asks, None])
        which, what = np.nonzero(near)
        if not len(which):
            continue
        kept.append((asks[which], rows[what], squares[which, what]))
        best_now = np.concatenate([worst[asks], np.where(near, squares, np.inf)], axis=1)
        worst[asks] = np.partition(best_now, k - 1, axis=1)[:, :k]
        furthest[asks] = np.minimum(furthest[asks], worst[asks].max(axis=1))
    if not kept:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    which, rows, squares = (np.concatenate(x) for x in zip(*kept))
    close = squares <= (furthest + slack)[which]
    which, rows = which[close], rows[close]
    order = np.argsort(which, kind="stable")
    return which[order], rows[order]


def plant(blocks: DataFrame, dim: int) -> DataFrame:
    """Each block with its tree's pages beside its rows."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                _, _, matrix = unpack(block["ids"], block["rows"], block["matrix"], dim)
                tree = build(lifted(matrix))
                parts = [tree.first, tree.point, tree.radius, tree.to_parent, tree.leads]
                columns = [pa.array([block["block"]], pa.int64())]
                columns += [pa.array([block[c]], pa.binary()) for c in ("ids", "rows", "matrix")]
                columns += [pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "rows", "matrix", "tree"])

    with few_rows_per_batch(blocks.sparkSession):
        return materialize(blocks.mapInArrow(grow, f"{BLOCK}, tree array<binary>"), "trees")


def top_k(
    df: DataFrame,
    queries: Column,
    *,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k rows of largest whole-number inner product.

    Each component x counts as floor(scale·x). All other rows are candidates, also those with the query's id; ties go to the
    smaller id. Vectors null or with null or non-finite components, and rows with a null id, take no part; zero vectors do; shorter
    vectors count as ending in zeros. Scores must stay below 2^53, where whole numbers are exact. With fewer than k
    candidates all are returned. Other columns are not read, so they cannot clash.
    """
    rows = rows_of(df, id_col, vector_col, queries, usable)
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    rows = rows.withColumn("vector", whole)
    dim = dimension(rows)
    trees = plant(pack(rows, BLOCK_ROWS, dim), dim)
    paired = tiles(pack(rows.filter("asked"), QUERY_ROWS, dim), trees)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, held = Heaps(k), 0
        for batch in batches:
            for tile in batch.to_pylist():
                q_ids, q_rows, q = unpack(tile["q_ids"], tile["q_rows"], tile["q_matrix"], dim)
                ids, numbers, matrix = unpack(tile["ids"], tile["rows"], tile["matrix"], dim)
                kinds = (np.int64, np.int64, np.float64, np.float64, np.int64)
                tree = Tree(*[np.frombuffer(p, dtype=t) for p, t in zip(tile["tree"], kinds)])
                entries = lifted(matrix)[tree.point]
                places = dict(zip(numbers.tolist(), range(len(numbers))))
                who = list(zip(q_rows.tolist(), q_ids.tolist()))
                own = np.array([places.get(row, -1) for row, _ in who], dtype=np.int64)
                for start in range(0, len(q), GROUP):
                    part = slice(start, start + GROUP)
                    floor = np.array([heaps.floor(w) for w in who[part]])
                    which, rows_ = search(tree, entries, q[part], k, own[part], floor)
                    scores = (matrix[rows_] * q[part][which]).sum(axis=1).astype(np.int64).tolist()
                    found = list(zip(scores, (-ids[rows_]).tolist(), (-numbers[rows_]).tolist()))
                    ends = np.searchsorted(which, np.arange(len(who[part]) + 1))
                    for i, w in enumerate(who[part]):
                        heaps.offer(w, found[ends[i] : ends[i + 1]])
                held += 1
            if held >= 64:
                yield heaps.batch(pa.int64())
                heaps, held = Heaps(k), 0
        yield heaps.batch(pa.int64())

    columns = ["q_ids", "q_rows", "q_matrix", "ids", "rows", "matrix", "tree"]
    with few_rows_per_batch(df.sparkSession):
        found = materialize(paired.select(*columns).mapInArrow(searched, FOUND), "found")
    return best(found, k)
