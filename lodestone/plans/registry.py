"""The catalogue: named queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """tables.orders reads orders.parquet of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table, dealt over all cores by the first one.

        Where a row becomes a text that is scanned, a small file is much work, and its one task would do all of it.
        """
        return getattr(self, name).select(*columns).repartition(4 * self.spark.sparkContext.defaultParallelism, columns[0])


def query(sql: str = ""):
    """Registers a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
