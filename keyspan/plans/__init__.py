"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from keyspan.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
