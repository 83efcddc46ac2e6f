"""Collects the queries of the plan modules."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.sources.views import expand

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "token_usage activity summary access event_intake debug_logs component_graph "
    "manifests incidents filing source_code flows packing conversations streams storage"
).split()

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# the check SQL as registered, for queries that are made of others
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a job; ``sql`` may name the views of ``sources.views`` in angle brackets."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name], ORACLES[name] = sql, expand(sql)
        return fn

    return keep


def load() -> None:
    for module in MODULES:
        if importlib.util.find_spec(f"faultline.plans.{module}"):
            importlib.import_module(f"faultline.plans.{module}")
