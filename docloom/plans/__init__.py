"""Registered queries: modules of (QUERIES, SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "record_queries", "monitoring_queries", "crawl_queries", "table_queries", "html_queries", "inference_queries", "source_queries", "more_queries", "rest_queries", "selector_queries", "tree_queries", "repair_queries", "service_queries")


def registered() -> tuple[dict, dict[str, str]]:
    queries: dict = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        m = import_module(f"docloom.plans.{name}")
        queries |= m.QUERIES
        sql |= {k: v for k, v in m.SQL.items() if v}
    return queries, sql
