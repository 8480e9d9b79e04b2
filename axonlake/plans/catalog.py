"""All registered queries of the library and their SQL."""

from __future__ import annotations

from axonlake.plans import audit_queries, graph_queries, report_queries, sample_queries, source_queries, stat_queries, stream_queries, time_queries  # noqa: F401  (they register their queries)
from axonlake.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
