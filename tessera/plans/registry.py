"""Queries and their SQL twins, collected by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names, queries and, where SQL can express them, equivalent statements."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            name = query.__name__
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = query
            if sql is not None:
                self.oracle[name] = sql
            return query

        return register
