"""Catalog of all queries."""

from barloom.plans.registry import CATALOG, Query
from barloom.plans import q_windows, q_scalars, q_sets, q_joins, q_project, q_aggregate, q_sources, q_quality, q_backtest, q_features, q_streaming

__all__ = ["CATALOG", "Query"]
