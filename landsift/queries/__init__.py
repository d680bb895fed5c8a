"""Registered queries over the given tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

AREAS = (
    "planning",
    "constraints",
    "networks",
    "parcels",
    "requests",
    "usage",
    "web",
    "documents",
    "conditions",
    "maps",
    "readers",
    "streams",
    "scalars",
    "results",
)

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return dict(_QUERIES), dict(_SQL)
