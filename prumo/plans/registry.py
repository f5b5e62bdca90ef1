"""Named queries over the given tables, each with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prumo.session import materialize, prepare


class Tables:
    """The given Parquet tables of one scale, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")
        self.stored: dict[str, DataFrame] = {}

    def store(self, name: str, make: Callable[[], DataFrame], codec: str = "snappy") -> DataFrame:
        """A derived table written once per query, however often the query reads it."""
        if name not in self.stored:
            self.stored[name] = materialize(make(), name, codec)
        return self.stored[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register `fn(tables)` under its name; without SQL it is checked by fixture tests only."""

    def register(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
