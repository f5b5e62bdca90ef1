"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.session import materialize

# Bounds what one Arrow batch of texts brings to a Python worker; a longer text travels alone.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "400",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def small_batches(df: DataFrame) -> DataFrame:
    """Set the Arrow batch bounds on the session of `df`."""
    for key, value in BATCHES.items():
        df.sparkSession.conf.set(key, value)
    return df


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no working column can clash with them."""
    return F.struct(*[named(c) for c in df.columns])


def numbered_ranges(df: DataFrame, order: Sequence[str], totals: Iterable[str] = ()) -> DataFrame:
    """Add `place` (from 0) and, for each column c of `totals`, `c_before` in the given total order.

    The table is cut into ranges of the order; each range is numbered on its own and
    shifted by the sums of the ranges before it, of which there are as many as partitions.
    """
    totals = list(totals)
    ranges = materialize(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"place": F.lit(1), **{c: F.col(c) for c in totals}}
    offsets = ranges.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in sums.items()])
    offsets = offsets.select(
        "_range", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(offsets, "_range")
    for k, v in sums.items():
        name = "place" if k == "place" else f"{k}_before"
        out = out.withColumn(name, F.col(f"_from_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_range", *[f"_from_{k}" for k in sums])


def sampled(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each value of column `by` at the most, chosen by a hash of column `key` and of the row's place in
    the table, so that rows with one key are chosen one by one: the bounded sample a classifier is fitted on. Adds
    `_share`, the part of the value's rows that was kept.

    The values are the classes of the model, of which it holds a column each on the driver; their shares go to
    every task, so that rows are not shuffled by a handful of values.
    """
    counts = df.groupBy(by).agg(F.count("*").alias("_rows"))
    shares = counts.select(by, F.least(F.lit(1.0), F.lit(float(most)) / F.col("_rows")).alias("_share"))
    number = F.pmod(F.xxhash64(named(key).cast("string"), F.monotonically_increasing_id(), F.lit("sample")), F.lit(1 << 30))
    placed = df.withColumn("_at", number / F.lit(float(1 << 30)))
    return placed.join(F.broadcast(shares), by).filter(F.col("_at") < F.col("_share")).drop("_at")


class Remembered:
    """What a Python worker has worked out per word: rows of a matrix, numbered by word.

    `work` turns a list of new words into such rows. The memory is emptied when it holds over `most` words.
    """

    def __init__(self, work: Callable[[list[str]], np.ndarray], most: int = 60_000):
        self.work, self.most = work, most
        self.known: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def of(self, words: list[list[str]]) -> np.ndarray:
        """The rows of all words, one list after the other."""
        if len(self.known) > self.most:
            self.known, self.rows = {}, None
        new = [w for w in set(chain.from_iterable(words)) if w not in self.known]
        if new or self.rows is None:
            rows = self.work(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = rows if self.rows is None else np.concatenate([self.rows, rows])
        count = sum(map(len, words))
        return self.rows[np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, count)]


def sums_per_list(values: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to zero."""
    sizes = np.asarray(sizes, dtype=np.int64)
    out = np.zeros((len(sizes), *values.shape[1:]), dtype=np.float64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        starts = (np.cumsum(sizes) - sizes)[filled]
        out[filled] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


_made: dict[str, object] = {}


def once_per_worker(tag: str, make: Callable[[], object]):
    """What `make` builds, kept in this Python worker until another tag is asked for."""
    if tag not in _made:
        forget_made()
        _made[tag] = make()
    return _made[tag]


def forget_made() -> None:
    """Lets go of what an earlier stage kept in this Python worker, which Spark uses again, and gives the memory back to
    the system: freed objects alone would stay with the process."""
    if _made:
        _made.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
