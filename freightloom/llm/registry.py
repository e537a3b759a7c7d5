"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from freightloom.llm.common import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql
