"""All registered queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, chat_queries, search_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (archive_queries, search_queries, chat_queries)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
