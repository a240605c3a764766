"""Named queries: a Spark callable and, where SQL can say it, the equivalent DuckDB text."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.sqltext import expand

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    """A named piece of oracle SQL and the pieces it reads."""
    _CTES[name] = (text.strip(), needs)


def sql(final: str, *needs: str) -> str:
    """The final SELECT under a WITH list of all pieces it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in _CTES[name][1]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    final = expand(final)
    if not order:
        return final.strip()
    head = ",\n".join(f"{n} AS ({expand(_CTES[n][0])})" for n in order)
    return f"WITH {head}\n{final.strip()}"


def query(name: str, rows: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a query; `rows` lists the SURVEY rows it covers."""

    def put(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, rows, build, oracle)
        return build

    return put
