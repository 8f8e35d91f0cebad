"""Registered queries over the benchmark tables, each with its SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the blueprint items it answers."""

    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from evidra.catalog import (  # noqa: F401
        curating, evaluating, graph, identity, ingestion, mining, provenance, summaries,
    )

    return REGISTRY
