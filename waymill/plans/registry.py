"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymill.session import table


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of Tables under its name."""

        def register(f):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return f(Tables(spark, folder))

            run.__doc__, run.__name__ = f.__doc__, f.__name__
            self.QUERIES[f.__name__] = run
            if sql:
                self.ORACLES[f.__name__] = sql
            return f

        return register
