"""Queries of the engine's own operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from lexiquarry.plans import graph_queries, mining_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, graph_queries, mining_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
