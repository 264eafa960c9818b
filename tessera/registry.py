"""Names of queries, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their oracle SQL; a name is taken once."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if oracle is not None:
            self.oracles[name] = oracle

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.add(name, fn, oracle)
            return fn

        return keep
