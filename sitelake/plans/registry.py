from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FAMILIES = (
    "sources_q",
    "scalars_q",
    "joins_q",
    "metrics_q",
    "windows_q",
    "select_q",
    "graph_q",
    "spatial_q",
    "splits_q",
    "ensemble_q",
    "streaming_q",
)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the statement with the same result."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf: fn(tune(spark, narrow=True), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"sitelake.plans.{family}")
