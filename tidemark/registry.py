"""The query catalogue: name -> (Spark callable, DuckDB twin, survey rows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; ``covers`` lists the operator ids it shows."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, sql, tuple(covers.split()))
        return fn

    return add


def load_all() -> dict[str, Query]:
    """Import every plan module (each registers its queries on import)."""
    import importlib
    import pkgutil

    from tidemark import plans

    for mod in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"tidemark.plans.{mod.name}")
    return QUERIES
