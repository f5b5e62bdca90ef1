"""Incremental sweep: portal pages arrive as files and are merged into a bucketed table of tenders.

A micro-batch replaces the buckets it touches (dynamic partition overwrite) and leaves the others alone. Its merged rows are
stored first, then its counts per day under its number, then the buckets are replaced from the stored rows. A batch that is
run again after a crash either finds no counts of its own and starts over from untouched buckets, or finds them and only
repeats the replacement; so nothing is counted twice and no bucket stays half replaced. Progress is the sum of the counts on
reading. Read the tables between runs: a bucket's files go when it is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.fixed_values import SOURCE_ZONE
from prumo.operators.merge import merge_tenders
from prumo.schemas import SWEEPS, TENDERS
from prumo.session import materialize, scratch
from prumo.sources.portal import ENVELOPE, open_envelopes, parse_tenders
from prumo.sources.sinks import bucket_of, with_bucket

ORDER = ["updated_at", "page", "raw"]
BUCKETS = 64
MERGED = T.StructType([*TENDERS.fields, T.StructField("inserted", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
COUNTED = T.StructType(
    [f for f in SWEEPS.fields if f.name != "closed"]
    + [T.StructField("new", T.LongType()), T.StructField("updated", T.LongType()), T.StructField("batch", T.LongType())]
)


def _table(spark: SparkSession, path: str, schema: T.StructType, by: str) -> DataFrame:
    """The partitioned table at a path, made empty where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _tenders(spark: SparkSession, state: str) -> DataFrame:
    return _table(spark, f"{state}/tenders", with_bucket(TENDERS), "bucket")


def _counts(spark: SparkSession, state: str) -> DataFrame:
    return _table(spark, f"{state}/sweeps", COUNTED, "batch")


def _replace(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def swept(spark: SparkSession, state: str) -> DataFrame:
    """All tenders as of the last finished micro-batch; empty when there is none."""
    return _tenders(spark, state).select(*TENDERS.fieldNames())


def sweep_progress(spark: SparkSession, state: str, today: Column | None = None) -> DataFrame:
    """Per day and modality: last page, totals, whether it is closed, and the tenders it brought new and again.

    A day read to its end and older than yesterday is closed: nothing more is expected of it. The totals are those that the
    latest batch names. A day or modality that is null is one like any other.
    """
    now = today if today is not None else F.current_date()
    latest = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))) for c in ("total_pages", "total_records")}
    days = _counts(spark, state).groupBy("day", "modality_id").agg(
        F.max("last_page").alias("last_page"),
        *[v.alias(c) for c, v in latest.items()],
        F.max("updated_at").alias("updated_at"),
        F.sum("new").alias("new"),
        F.sum("updated").alias("updated"),
    )
    whole = (F.col("last_page") >= F.col("total_pages")) & (F.col("day") < F.date_sub(now, 1))
    return days.withColumn("closed", F.coalesce(whole, F.lit(False))).select(*SWEEPS.fieldNames(), "new", "updated")


def _counted(arrived: DataFrame, merged: DataFrame, number: int) -> DataFrame:
    """What a batch read of each day and modality, and the tenders it brought there: one grouping of both, without a join."""
    key = [F.to_date(F.from_utc_timestamp("published_at", SOURCE_ZONE)).alias("day"), "modality_id"]
    came = merged.join(arrived.select("id").distinct(), "id", "left_semi").select(*key, "inserted")
    read = arrived.select(*key, "page", "total_pages", "total_records", "updated_at")
    most = (("page", "last_page"), ("total_pages", "total_pages"), ("total_records", "total_records"))
    return (
        read.unionByName(came, allowMissingColumns=True)
        .groupBy("day", "modality_id")
        .agg(
            *[F.max(c).cast("int").alias(n) for c, n in most],
            F.max("updated_at").alias("updated_at"),
            F.count_if("inserted").alias("new"),
            F.count_if(~F.col("inserted")).alias("updated"),
            F.lit(number).cast("long").alias("batch"),
        )
        .select(*COUNTED.fieldNames())
    )


def merge_batch(arrived: DataFrame, number: int, state: str, buckets: int = BUCKETS) -> None:
    """Merge parsed tenders into the table as micro-batch `number`. The latest batch may be given again, whole, any number
    of times; an empty one changes nothing."""
    spark = arrived.sparkSession
    merged_path, counts_path = f"{state}/merged", f"{state}/sweeps"
    if _counts(spark, state).where(F.col("batch") == number).isEmpty():
        with scratch(spark, "sweep"):
            arrived = materialize(arrived.withColumn("bucket", bucket_of(["id"], buckets)), "arrived")
            touched = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # at most the buckets
            current = _tenders(spark, state).where(F.col("bucket").isin(touched)).drop("bucket")
            fresh = arrived.drop("total_pages", "total_records", "bucket")
            merged = merge_tenders(current, fresh, ORDER).withColumn("bucket", bucket_of(["id"], buckets))
            merged.select(*MERGED.fieldNames()).write.mode("overwrite").parquet(merged_path)
            merged = spark.read.schema(MERGED).parquet(merged_path)
            # One file, so that the counts of a batch are there whole or not at all: they say that its rows are stored.
            _replace(_counted(arrived, merged, number).coalesce(1), counts_path, "batch")
    stored = spark.read.schema(MERGED).parquet(merged_path)
    # The stored rows were dealt out by the merge: they are put in their buckets where they are read.
    _replace(stored.drop("inserted"), f"{state}/tenders", "bucket")


def sweep(
    spark: SparkSession,
    source: str,
    state: str,
    accept: Column | None = None,
    multi_line: bool = True,
    files_per_batch: int = 100,
    buckets: int = BUCKETS,
) -> None:
    """Merge all envelopes that arrived under `source` since the last run, then stop.

    `accept` is a condition on parsed tenders, for instance that their day is still open:
    a plain filter, since no operator of this stream keeps event-time state. `buckets` is fixed for a `state`
    folder: a bucket is what a micro-batch rewrites, so their number grows with the table.
    """
    envelopes = (
        spark.readStream.schema(ENVELOPE)
        .option("multiLine", str(multi_line).lower())
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )

    def merge(batch: DataFrame, number: int) -> None:
        arrived = parse_tenders(open_envelopes(batch))
        merge_batch(arrived if accept is None else arrived.where(accept), number, state, buckets)

    run = (
        envelopes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{state}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def is_recent(published_at: str, today: Column) -> Column:
    """Days older than yesterday are closed: what still arrives for them is left out."""
    return F.to_date(F.col(published_at)) >= F.date_sub(today, 1)
