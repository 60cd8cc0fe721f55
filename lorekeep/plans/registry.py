"""Where queries are registered, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.tables import Tables
from .oracle import with_tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Parameters of the queries: the erased client, the asking clients, the instants.
CLIENT, CLIENTS = 3, [3, 7, 11]
NOW = "2024-02-20 00:00:00"


def query(name: str, sql: str | None = None, **tables: str):
    """Register a function of ``Tables``; ``tables`` are more tables its SQL names."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql, **tables)
        return f

    return put
