"""Registry of runnable queries and the SQL each is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .projection import NOTES_SQL, RESULTS_SQL, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the views ``notes`` and ``results``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix the projections a check text mentions as common table expressions."""
    parts = []
    body = sql.strip()
    for view, text in (("notes", NOTES_SQL), ("results", RESULTS_SQL)):
        if f" {view}" in body:
            parts.append(f"{view} as ({duck(text)})")
    if not parts:
        return body
    if body[:5].lower() == "with ":
        recursive = body[5:15].lower() == "recursive "
        rest = body[15:] if recursive else body[5:]
        return f"with {'recursive ' if recursive else ''}{', '.join(parts)}, {rest}"
    return f"with {', '.join(parts)} {body}"
