"""Registered queries: a function over (spark, sf_dir) and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder, read lazily: t.events is spark.read.parquet(folder/events.parquet)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers f(tables) under name."""

        def take(f):
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return f

        return take
