"""Demonstration queries with their SQL."""

from tidegrid.plans import aggregate_queries, cell_queries, join_queries, network_queries, score_queries, series_queries, source_queries, table_queries  # noqa: F401
from tidegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
