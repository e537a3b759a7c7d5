"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freightloom.sources import ORDER_ITEMS_SQL, order_items, order_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str, **views: str) -> str:
    """Prefix a statement with the order-line view and further named views it uses; those are computed once each."""
    named = [f"oi AS ({ORDER_ITEMS_SQL})", *[f"{n} AS MATERIALIZED ({body})" for n, body in views.items()]]
    return "WITH " + ", ".join(named) + " " + sql


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        register(name, run, sql)
        return run

    return add


def over_items(name: str, run: Callable[[DataFrame], DataFrame], columns: str, sql: str | None = None, **views: str) -> None:
    """Register a query that needs only some columns of the order lines."""
    register(
        name,
        lambda spark, sf_dir: run(order_items(spark, sf_dir, *columns.split())),
        None if sql is None else with_views(sql, **views),
    )


def over_lines(name: str, run: Callable[[DataFrame], DataFrame], columns: str, sql: str | None = None, **views: str) -> None:
    """Like over_items for jobs that read the lines several times: they read the joined table kept in the shared folder."""
    register(
        name,
        lambda spark, sf_dir: run(order_lines(spark, sf_dir, *columns.split())),
        None if sql is None else with_views(sql, **views),
    )
