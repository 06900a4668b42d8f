"""Registered queries: the engine's form and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, ctes: str = "") -> Callable:
    """Register a function of the canonical tables; ``select`` (and ``ctes``) is its SQL, if SQL can express it."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if select:
            ORACLES[name] = sql(select, ctes)
        return f

    return keep
