"""All queries of the core and their SQL."""

from __future__ import annotations

from hunkyard.plans import change_queries, diff_queries, graph_queries, hierarchy_queries, review_queries

MODULES = [change_queries, diff_queries, graph_queries, review_queries, hierarchy_queries]
FLAGSHIP = "chunk_pack"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
