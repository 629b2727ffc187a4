"""Collects named queries: a function of (spark, sf_dir), and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from ..sources.tables import GRAPH_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    """Registers a function; sql starts with further common table expressions or a SELECT, after the graph's if graph."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            text = sql.strip()
            if graph:
                text = f"WITH {GRAPH_SQL}{', ' if not text.upper().startswith('SELECT') else ' '}{text}"
            SQL[name] = text
        return function

    return register
