"""All queries of the trajectory part and their SQL."""

from __future__ import annotations

from . import box_queries, route_queries, source_queries, stream_queries  # noqa: F401  (they register themselves)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
