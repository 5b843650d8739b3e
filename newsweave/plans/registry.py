"""Registry of runnable queries and, next to each, the equivalent SQL used to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from newsweave.session import use_utc

            return function(use_utc(spark), sf_dir)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[name] = run
        if sql:
            CHECK_SQL[name] = sql
        return function

    return keep
