"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans import registry

for _name in ("q_objects", "q_filters", "q_joins", "q_retrieval", "q_aggregates", "q_graph", "q_algorithms", "q_streaming", "q_more", "q_sinks", "q_tiers"):
    import_module(f"recallix.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
