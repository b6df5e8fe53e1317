"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    "spatial",
    "tracklet",
    "association",
    "timeline",
    "index",
    "matching",
    "evaluation",
    "observation",
    "review",
    "source",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in _MODULES:
        found.update(import_module(f"trafficloom.workload.{name}_queries").QUERIES)
    return found
