"""All queries of the engine by name, with the SQL that each must equal."""

from __future__ import annotations

from . import dialogue_queries, evaluation_queries, repair_queries, retrieval_queries, text_queries, validation_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
