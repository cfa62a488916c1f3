"""Registered queries: each pairs a Spark job over the given tables with a DuckDB statement."""

from __future__ import annotations

from sheafwork.plans import (  # noqa: F401
    catalog_queries, graph_queries, quality_queries, report_queries, retrieval_queries, run_queries,
    sensitive_queries, source_queries, store_queries, text_queries,
)
from sheafwork.plans.registry import QUERIES

__all__ = ["QUERIES"]
