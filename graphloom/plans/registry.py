"""Named queries over the driver tables, and their SQL counterparts."""

from __future__ import annotations

from . import code_queries, graph_queries, search_queries, text_queries  # noqa: F401  they register themselves
from .catalog import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
