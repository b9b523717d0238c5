"""Registry of named queries and the ANSI SQL each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix the view definitions (CTEs) a statement uses, in dependency order."""
    from tidemark.plans.views import VIEW_SQL

    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(VIEW_SQL[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):].lstrip()}"
    return f"WITH {ctes}\n{body}"
