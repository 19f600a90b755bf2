"""All registered queries and their oracles."""

from __future__ import annotations

from . import file_queries, registry_queries, run_queries, spatial_queries  # noqa: F401  (they register themselves)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
