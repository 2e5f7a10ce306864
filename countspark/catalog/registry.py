"""Registry of queries and of the SQL that states the same result.

``VIEWS`` holds the SQL of the input views; ``sql(body)`` puts the views a body mentions in front of it as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def sql(body: str) -> str:
    """``body`` preceded by the views it needs, directly or through other views, in order of definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    ctes = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    if not ctes:
        return body.strip()
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"WITH {ctes} {body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` together with its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)
