"""All queries of the timeline engine."""

from __future__ import annotations

from chronoframe.plans import event_queries, frame_queries, interval_queries, plan_queries, rule_queries, signal_queries, stream_queries, text_queries  # noqa: F401  each module adds its queries
from chronoframe.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
