"""Registry of named queries: a Spark builder and, where SQL can express the
operator, the equivalent DuckDB SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, headline)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules fills the registry.
    import importlib

    for mod in MODULES:
        importlib.import_module(f"vigil.plans.{mod}")
    return REGISTRY


MODULES = ["q_metrics", "q_logs", "q_detect", "q_memory", "q_reports", "q_streaming", "q_cluster", "q_eval", "q_bundle", "q_misc"]
