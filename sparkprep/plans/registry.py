"""Registry of named queries: each is a Spark build function (spark, sf_dir) ->
DataFrame and, where SQL can express it, a DuckDB oracle over the same tables.

Output conventions shared with the oracles: flat columns only, counts as
BIGINT, ratios rounded to 6 places as DOUBLE.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    sql: str | None  # None: not expressible in SQL -> rows-only check
    operators: tuple[str, ...] = ()


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, operators: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def add(name: str, fn: QueryFn, sql: str | None, operators: tuple[str, ...] = ()) -> None:
    register(name, sql, operators)(fn)


def all_queries() -> dict[str, Query]:
    from . import catalog  # noqa: F401  (registers everything on import)
    return dict(_REGISTRY)
