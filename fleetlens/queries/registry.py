"""Collects ``name -> (query, SQL)`` from the area modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import FINE_SHUFFLES, apply_runtime_conf

Query = Callable[[SparkSession, str], DataFrame]

AREAS = ("faults", "store", "failures", "character", "bursts", "points", "evaluation", "monitoring", "history", "memory", "models", "streams")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB twin over the same tables."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_conf(spark, **FINE_SHUFFLES)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    for area in AREAS:
        import_module(f"fleetlens.queries.{area}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
