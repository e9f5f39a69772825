"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from tallyspark.plans import actions, documents, lists, matching, reads, state, text  # noqa: F401  (each registers its queries)
from tallyspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
