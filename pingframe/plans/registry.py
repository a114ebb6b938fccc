"""All registered queries and their SQL. A query module adds its own with @query."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pingframe.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "flt08_filtered_page"


def query(name: str, sql: str | None = None, *on: str) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; sql may use the views named in `on`."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = views.oracle(sql, *on) if on else sql
        return f

    return add


for _module in ("detections", "navigation", "waterfall", "evaluation", "catalogue", "jobs", "exports", "models", "masks"):
    importlib.import_module(f"pingframe.plans.{_module}")
