"""Reference SQL, one statement per registered query."""

from __future__ import annotations

from importlib import import_module

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


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found.update(import_module(f"oracles.{name}").SQL)
    return found
