"""Registered queries; importing this package fills the registry."""

from . import agenda_queries, calendar_queries, circuit_queries, data_queries, depth_queries, detail_queries, entity_queries, event_queries, linkage_queries, pair_queries, policy_queries, sink_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
