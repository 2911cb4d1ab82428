"""Name -> query callable registry used by ``__spark_entry__.queries()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # importing the modules registers their queries
    from . import (queries_core, queries_drift, queries_features, queries_io, queries_model,  # noqa: F401
                   queries_monitor, queries_stream)
    return dict(REGISTRY)
