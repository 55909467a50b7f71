"""Where queries are entered: a function of (spark, sf_dir) by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.sources.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Enter a function under its own name. ``sql`` follows the named views (a leading comma adds further ones)."""

    def enter(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            named = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
            SQL[f.__name__] = f"WITH RECURSIVE {named} {sql}" if views else sql
        return f

    return enter
