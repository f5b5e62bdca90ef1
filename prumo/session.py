"""Session settings and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Where a join feeds an aggregation that shuffles anyway, splitting a hot key is worth it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "prumo", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would vanish with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    folder = tempfile.mkdtemp(prefix="prumo-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Folders of the scopes that are open, innermost last.
_scopes: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, or under that of the innermost scope, that no other run uses."""
    return os.path.join(_scopes[-1] if _scopes else shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession, name: str = "scope") -> Iterator[str]:
    """A scope for intermediate tables: what is materialized inside it is deleted at its end, so results must be
    written elsewhere or collected before."""
    folder = fresh_path(spark, name)
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of the files at a path: what tells one state of a table from another."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(place))


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a stage once and read it back: cuts lineage, survives lost executors,
    and gives the optimiser real sizes for what follows. Texts may be stored smaller by another codec."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
