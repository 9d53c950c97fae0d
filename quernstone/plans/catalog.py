"""Queries by name over the test tables, and the SQL that states the same results."""

from __future__ import annotations

from quernstone.plans import data_queries, dedup_queries, generate_queries, text_queries, verify_queries  # noqa: F401
from quernstone.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
