"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.llm.common import named, row_of
from prumo.session import materialize

# Ranges per shard in which slots are counted side by side.
BUCKETS = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    """Exponential waiting time of a shard: the smallest wins, a shard of double weight twice as often."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 …) that `key` falls to. A shard's score depends on the key and that shard alone,
    so one more shard takes rows only into itself. Equal scores go to the smaller shard; a null key is a key like any other."""
    scores = [F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*scores))["shard"]


def shard(
    docs: DataFrame, weights: Sequence[float], *, more: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard, slot within the shard and shard after growth, for each row of `docs`.

    Returns id, size (UTF-8 bytes of the text and 8; a null text has none), text_crc32, shard, slot
    (from 0 without gaps, by bucket, id, checksum and size) and grown_shard (with one more shard, of weight `more`).
    Rows with one id fall to one shard. A null text has a null checksum. Equal rows share
    out their slots. An empty table gives an empty result; other columns are not read.

    Slots: rows are counted per (shard, bucket of a hash) first, the counts of a shard put in
    sequence, and only rows of one bucket numbered together.
    """
    key, text = named(id_col).cast("string"), named(text_col)
    rows = docs.select(
        named(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, more]).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.crc32(text), F.lit("slot")), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    rows = materialize(rows, "shard-rows")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    return rows.join(starts, ["shard", "bucket"]).select(
        "id",
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def sharded_rows(docs: DataFrame, weights: Sequence[float], *, id_col: str = "doc_id") -> DataFrame:
    """The rows themselves as struct `row` with their `shard`, ready for `write.partitionBy("shard")`."""
    return docs.select(row_of(docs).alias("row"), rendezvous(named(id_col).cast("string"), weights).alias("shard"))
