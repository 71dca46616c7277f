"""Registered queries: for each, a function of (spark, directory) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; `register` adds one, with its SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def register(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            key = name or query.__name__
            self.queries[key] = query
            if sql is not None:
                self.sql[key] = sql
            return query

        return add
