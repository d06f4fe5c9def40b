"""Registry of named queries: each has a DataFrame builder and, where SQL can say it, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


class Catalogue:
    """Queries by name, in order of registration."""

    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        def register(build: Builder) -> Builder:
            if name in self._queries:
                raise ValueError(f"query {name} is registered twice")
            self._queries[name] = Query(build, sql)
            return build

        return register

    def builders(self) -> dict[str, Builder]:
        return {name: q.build for name, q in self._queries.items()}

    def oracle(self) -> dict[str, str]:
        return {name: q.sql for name, q in self._queries.items() if q.sql}
