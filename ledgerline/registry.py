"""Registry of named queries: ``name -> (builder, oracle SQL)``.

A builder takes ``(spark, tables)`` and returns a DataFrame; the oracle SQL (optional) is the
same computation in DuckDB SQL over the same Parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sources.adapters import ADAPTERS
from .sources.shared import follow_sources


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, dict], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql.strip() if sql else None)
        return fn
    return deco


def with_domain(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the adapters ``names`` as CTEs (merging a leading WITH)."""
    ctes = ",\n".join(f"{n} AS (\n{ADAPTERS[n].duckdb()}\n)" for n in names)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def domain(spark: SparkSession, tables, name: str) -> DataFrame:
    """Domain table ``name`` built from the driver tables (cached per Tables object); shuffles follow the size of those tables."""
    key = "@" + name
    if key not in tables:
        inputs = [tables[x] for x in ADAPTERS[name].inputs]
        if inputs:
            follow_sources(*inputs)
        tables[key] = ADAPTERS[name].spark(spark, tables)
    return tables[key]
