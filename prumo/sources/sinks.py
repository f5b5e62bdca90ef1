"""Writing: replaced partitions, dated results, seed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.session import materialize


def with_bucket(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A table laid out by parent bucket, ready for `replace_in_place`."""
    df.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket", *keys).write.partitionBy("bucket").parquet(path)


def replace_in_place(fresh: DataFrame, touched: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Replace the children of the touched parents in a table laid out by bucket.

    Only buckets with a touched parent are rewritten; within them the children of other parents
    are kept. The new content is stored before anything is overwritten, so no job reads what it
    replaces.
    """
    spark = fresh.sparkSession
    parents = touched.select(*keys).distinct().withColumn("bucket", bucket_of(keys, buckets))
    affected = parents.select("bucket").distinct()
    current = spark.read.schema(with_bucket(fresh.schema)).parquet(path).join(affected, "bucket", "left_semi")
    kept = current.join(parents, [*keys, "bucket"], "left_anti")
    after = kept.select(*fresh.columns, "bucket").unionByName(fresh.withColumn("bucket", bucket_of(keys, buckets)))
    stored = materialize(after, "replaced")
    emptied = materialize(affected.join(stored.select("bucket").distinct(), "bucket", "left_anti"), "emptied")
    (
        stored.repartition("bucket", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    # A bucket left without rows has nothing to overwrite it with: its old files go.
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in emptied.collect():  # at most the number of buckets
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"bucket={row.bucket}"), True)


def write_results(df: DataFrame, path: str, day: str) -> str:
    """Scored cases as JSON under a folder named by day."""
    target = f"{path.rstrip('/')}/day={day}"
    df.write.mode("overwrite").json(target)
    return target


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).json(f"{path.rstrip('/')}/day=*")


def seed_if_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows where it has none. One row is enough to know."""
    return table.unionByName(seed) if table.isEmpty() else table
