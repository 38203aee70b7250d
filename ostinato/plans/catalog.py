"""Names queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ostinato.runtime import ship_package

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name; without ``sql`` tests hold it against another form."""

    def register(function: Callable) -> Callable:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @wraps(function)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = shipped
        if sql:
            ORACLE[name] = sql
        return function

    return register
