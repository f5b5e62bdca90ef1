"""Per-key building blocks that stay safe when one key holds a large share of all rows.

None of them gathers a whole group in one task: last-per-key and top-k reduce before
the shuffle, and numbering works on ranges of (key, order), context and running maxima on (key, block) pieces,
whose totals are combined in a second, much smaller step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prumo.session import materialize

BLOCK = 4096


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key; remaining columns break ties so the choice is total.

    A `max` over a struct: partial results are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, "_last.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """The first k rows per key, numbered from 1. Spark limits each input partition to k rows per key before the
    shuffle, so a hot key never travels whole, as long as k is at most spark.sql.optimizer.windowGroupLimitThreshold
    (1,000 unless set). For a larger k use `number_rows` and a filter."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Sum of `value` over the rows before each row of its key, exact, however many rows one key has.

    Rows are dealt out in ranges of (keys, order), so a hot key spans many of them, also when all its rows share
    the leading part of the order. Rows are added up inside (key, range); what lies before a range comes from
    the sums per (key, range). The ranges are written once, since sampling could cut them elsewhere if they were made again.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(*[F.col(k) for k in keys], *order)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("_value").alias("_sum"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_range").alias("_r"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        )
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(totals, same)
        .withColumn(name, (F.sum("_value").over(inside) - F.col("_value") + F.col("_sum_before")).cast("long"))
        .drop("_value", "_range", "_r", "_sum_before", *[f"_k{i}" for i in range(len(keys))])
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """`row_number` over `keys`, as a running total of ones. The order must be total."""
    return running_total(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def with_block_context(df: DataFrame, number: str, back: int, block: int = BLOCK) -> DataFrame:
    """Cut numbered rows into blocks; the last `back` rows of a block also appear in the next
    one with `_own` false, so a window over (key, `_piece`) sees its full frame."""
    n = F.col(number) - 1
    piece = F.floor(n / block)
    late = (n % block) >= block - back
    copies = F.when(
        late,
        F.array(
            F.struct(piece.alias("_piece"), F.lit(True).alias("_own")),
            F.struct((piece + 1).alias("_piece"), F.lit(False).alias("_own")),
        ),
    ).otherwise(F.array(F.struct(piece.alias("_piece"), F.lit(True).alias("_own"))))
    return df.select("*", F.inline(copies))


def previous_rows(
    df: DataFrame, keys: Sequence[str], number: str, value: Column, n: int, name: str, block: int = BLOCK
) -> DataFrame:
    """Up to n earlier values before each row, oldest first. `number` counts rows per key."""
    window = Window.partitionBy(*keys, "_piece").orderBy(number).rowsBetween(-n, -1)
    return (
        with_block_context(df, number, n, block)
        .withColumn(name, F.collect_list(value).over(window))
        .where("_own")
        .drop("_piece", "_own")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], number: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """`lag` by one row, block by block."""
    window = Window.partitionBy(*keys, "_piece").orderBy(number)
    return (
        with_block_context(df, number, 1, block)
        .withColumn(name, F.lag(value).over(window))
        .where("_own")
        .drop("_piece", "_own")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], number: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Running maximum along `number`: maxima of whole blocks first, then inside each block."""
    df = df.withColumn("_v", value).withColumn("_piece", F.floor((F.col(number) - 1) / block))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        df.groupBy(*keys, "_piece")
        .agg(F.max("_v").alias("_m"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_piece").alias("_p"),
            F.max("_m").over(before).alias("_head"),
        )
    )
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = (
        Window.partitionBy(*keys, "_piece").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.join(heads, same)
        .withColumn(name, F.greatest(F.max("_v").over(inside), F.col("_head")))
        .drop("_v", "_piece", "_head", "_p", *[f"_k{i}" for i in range(len(keys))])
    )
