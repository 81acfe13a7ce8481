"""Registered queries and their SQL equivalents."""

from demandlens.catalog.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
