"""The engine's registered queries, by name, and the SQL they are held against."""

from __future__ import annotations

from lexispark.plans import bitset_queries, engine_queries, functions_queries, relational, shaped_queries, source_queries, sql_queries, text_queries
from lexispark.plans.text_queries import flagship

ALL = text_queries.Q | relational.Q | functions_queries.Q | sql_queries.Q | shaped_queries.Q | source_queries.Q | bitset_queries.Q | engine_queries.Q

__all__ = ["ALL", "flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
