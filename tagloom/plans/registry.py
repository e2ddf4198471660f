"""Queries by operator name, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.plans.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in order and name in SQL_VIEWS:
                need(SQL_VIEWS[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in order)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'^WITH\s+RECURSIVE', '', body, flags=re.I)}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under an operator's name."""

    def keep(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = _with_views(sql)
        return fn

    return keep
