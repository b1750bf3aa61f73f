"""Derived relations and registered queries."""

from __future__ import annotations

from assaylake.plans import evaluation_queries, ledger_queries, retrieval_queries, stream_queries, text_queries
from assaylake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation_queries", "ledger_queries", "retrieval_queries", "stream_queries", "text_queries"]
