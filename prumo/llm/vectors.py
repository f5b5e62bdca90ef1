"""Vectors in blocks: tables of packed matrices, paired block by block.

Every query block meets every block of rows in a tile; a tile is one row of a table, so its size is bounded by the
block sizes and tiles are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prumo.llm.common import named
from prumo.session import materialize

QUERY_ROWS = 512
BLOCK_ROWS = 4096
BLOCK = "block long, ids binary, rows binary, matrix binary"


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )


def rows_of(
    df: DataFrame, id_col: str, vector_col: str, queries: Column, keep: Callable[[Column], Column]
) -> DataFrame:
    """(id, vector, asked, row) of the vectors that take part, written once; `row` tells rows with one id apart."""
    vector = named(vector_col).cast("array<double>")
    asked = F.coalesce(queries, F.lit(False)).alias("asked")
    out = df.select(named(id_col).cast("long").alias("id"), vector.alias("vector"), asked).filter(
        F.col("id").isNotNull() & keep(F.col("vector"))
    )
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "vectors")


def pack(rows: DataFrame, size: int, dim: int) -> DataFrame:
    """Blocks of about `size` rows each: ids, row numbers and a float64 matrix; short vectors end in zeros."""
    count = rows.count()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, parts = [], [], []
        for batch in batches:
            vectors = batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            part = np.zeros((len(vectors), dim))
            part[np.arange(dim) < lengths[:, None]] = vectors.flatten().to_numpy()
            parts.append(part)
            ids.append(batch.column(0).to_numpy())
            numbers.append(batch.column(1).to_numpy())
        if parts:
            columns = [np.concatenate(x).tobytes() for x in (ids, numbers, parts)]
            block = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([block, *[pa.array([c], pa.binary()) for c in columns]], ["block", "ids", "rows", "matrix"])

    dealt = rows.select("id", "row", "vector").repartition(max(1, ceil(count / size)))
    return materialize(dealt.mapInArrow(packed, BLOCK), "blocks")


def dimension(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def unpack(ids: bytes, rows: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(ids, dtype=np.int64),
        np.frombuffer(rows, dtype=np.int64),
        np.frombuffer(matrix, dtype=np.float64).reshape(-1, dim),
    )


def tiles(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each query block (q_…) beside each block of rows, one query block after the other.

    A task takes some query blocks and some blocks of rows, which it reads from their tables: neither the driver nor a shuffle
    holds a tile. The hint keeps Spark from broadcasting a table that is small only as it is stored.
    """
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return asked.hint("shuffle_replicate_nl").crossJoin(blocks)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from what tiles found: highest score, then smaller id."""
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@contextmanager
def few_rows_per_batch(spark: SparkSession) -> Iterator[None]:
    """While a table is made whose rows are blocks or tiles: few of them go into an Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        yield
    finally:
        spark.conf.set(key, before)
