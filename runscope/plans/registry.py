"""Query registry: every operator of the inventory as a named query over the driver tables, paired with its
DuckDB oracle SQL (None where the operator is not expressible in SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    ids: str  # inventory ids this query covers


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, ids: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Query(name, fn, oracle, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the query modules fills the registry.
    from runscope.plans import (queries_misc, queries_quality, queries_runs, queries_stream,  # noqa: F401
                                queries_trace, queries_triage, queries_warehouse)
    return REGISTRY
