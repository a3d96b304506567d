"""Registration of queries: each with its name and, where it has one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.QUERIES:
                raise ValueError(f"registered twice: {name}")
            self.QUERIES[name] = f
            if sql is not None:
                self.SQL[name] = sql
            return f

        return add
