"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from .plans.cohort_queries import QUERIES
from .plans.cohort_sql import SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
