"""The queries of the core: name -> callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, history_queries, library_queries, retrieval_queries, text_queries, unit_queries

_MODULES = (retrieval_queries, text_queries, history_queries, library_queries, answer_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()} | unit_queries.QUERIES
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "q_hybrid_search"
