"""Registration of queries with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class QuerySet:
    """Named queries; ``sql`` is left out where SQL cannot express the result."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query: {name}")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql.strip()
            return function

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
