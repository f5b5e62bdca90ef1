"""Postings kept as a table laid out by word, so that looking words up shuffles neither texts nor postings.

Rows lie in buckets of (lexeme, shard), sorted by word within a bucket. The shard comes from the text's key: a word in a
third of all texts is spread over SHARDS buckets. A lookup brings its few words, once per shard, to the buckets.

A text that is read again gets a higher version: its postings are appended, and rows of versions that are no longer
current are left out at lookup, until the table is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prumo.session import fresh_path

SHARDS = 16
BUCKETS = 64  # for some gigabytes; choose more for a larger table


def _placed(posted: DataFrame, keys: list[str], version: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")
    return posted.withColumn("shard", shard).withColumn("version", F.lit(version).cast("long"))


def write_index(posted: DataFrame, name: str, keys: list[str], version: int = 1, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Keep `posted(keys, lexeme, …)` as table `name`, each bucket written by one task as one sorted file."""
    _write(_placed(posted, keys, version), name, keys, buckets, path or fresh_path(posted.sparkSession, name))


def _write(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> None:
    placed = rows.repartition(buckets, "lexeme", "shard")
    writer = placed.write.format("parquet").bucketBy(buckets, "lexeme", "shard").sortBy("lexeme", *keys)
    writer.mode("append").option("path", path).saveAsTable(name)


def append_index(posted: DataFrame, name: str, keys: list[str], version: int) -> None:
    """Add the postings of texts that are new or were read again, under a version higher than any before."""
    spark = posted.sparkSession
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    _write(_placed(posted, keys, version), name, keys, int(about["Num Buckets"]), about["Location"])


def look_up(spark: SparkSession, name: str, words: DataFrame, keys: list[str], current: DataFrame | None = None) -> DataFrame:
    """The postings of `words(lexeme)`, of the texts and versions in `current(keys, version)` if given.

    The table is read in its buckets, with no exchange; of its row groups only those are read that can hold a word.
    """
    shards = F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard")
    wanted = words.select("lexeme").distinct().select("lexeme", shards)
    found = spark.table(name).join(wanted, ["lexeme", "shard"], "left_semi").drop("shard")
    if current is not None:
        found = found.join(current.select(*keys, "version"), [*keys, "version"], "left_semi")
    return found.drop("version")
