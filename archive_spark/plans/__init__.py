"""Registered queries and their SQL."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
