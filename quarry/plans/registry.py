"""All registered queries and their SQL, by name."""

from __future__ import annotations

from quarry.plans import audits, collections, functions, incremental, matching, merges, sources
from quarry.plans.tables import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "audits", "collections", "functions", "incremental", "matching", "merges", "sources"]

FLAGSHIP = "a1_collection_stats"
