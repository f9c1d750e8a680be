"""Registry of the runnable queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import join_by_measured_size

Query = Callable[[SparkSession, str], DataFrame]


class Group:
    """Queries of one operator group; ``oracle`` is the DuckDB SQL over the same parquet tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")

            @wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                join_by_measured_size(spark)
                return fn(spark, sf_dir)

            self.queries[name] = run
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register
