"""Registration of queries next to their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.session import load


class Registry:
    """Queries by name. A builder takes t, a function from table name to DataFrame."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(build: Callable[..., DataFrame]):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda table: load(spark, sf_dir, table))

            query.__name__ = name
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return build

        return put
