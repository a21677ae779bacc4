"""Registry of catalogued queries: name -> (Spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (or data Spark derives from them).  A ``None`` oracle means the
query is checked on rows only plus its own unit tests (formatting differences,
model-dependent output or an approximate algorithm).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Builder, str | None]] = {}
_LOADED = False

AREAS = ("vectors", "tree", "sync", "query", "retrieve", "digest", "blocks", "edits", "plans", "ci")


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, oracle)
        return fn

    return deco


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"quarry.plans.cases.{area}")


def catalog() -> dict[str, tuple[Builder, str | None]]:
    global _LOADED
    if not _LOADED:
        _load()
        _LOADED = True
    return dict(_REGISTRY)


def builders() -> dict[str, Builder]:
    return {k: v[0] for k, v in catalog().items()}


def oracles() -> dict[str, str]:
    return {k: v[1] for k, v in catalog().items() if v[1] is not None}
