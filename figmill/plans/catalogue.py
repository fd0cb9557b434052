"""All queries of the core and their SQL."""

from __future__ import annotations

from figmill.plans import aggregate_plans, array_plans, evaluation_plans, gate_plans, order_plans, text_plans  # noqa: F401
from figmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
