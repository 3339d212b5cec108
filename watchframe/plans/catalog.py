"""All checked queries."""

from watchframe.plans import (detect_queries, enrich_queries, manage_queries,  # noqa: F401
                              stream_queries, time_queries)
from watchframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
