"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .recruiting import with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with SQL over the driver's tables and the recruiting views."""

        def register(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracle[function.__name__] = with_views(sql)
            return function

        return register
