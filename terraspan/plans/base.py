"""Registration of named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_views
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, *views: str, recursive: str = ""):
    """Register a function of :class:`Views`; ``body`` is the SQL it has to agree with, over ``views``."""

    def wrap(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if body is not None:
            ORACLES[name] = with_views(body, *views, recursive=recursive)
        return build

    return wrap
