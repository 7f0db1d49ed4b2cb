"""Every query over the given tables, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import coverage_queries, index_queries, merge_queries, name_queries, panel_queries, register_queries, shelf_queries, tag_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (index_queries, merge_queries, coverage_queries, shelf_queries, name_queries, register_queries, panel_queries, tag_queries):
    QUERIES |= {name: query for name, (query, _) in _module.ALL.items()}
    ORACLE_SQL |= {name: sql for name, (_, sql) in _module.ALL.items() if sql}
