"""The registered queries: every operator over its whole tables, with the SQL it is checked against
where SQL can say it. The SQL is written from what a query means, in other forms than the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "job_counters"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# the modules register themselves
from webspark.plans import pages_queries, search_queries, store_queries  # noqa: E402,F401
