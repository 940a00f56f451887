"""Named queries on the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read when asked for."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
