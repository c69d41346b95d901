"""The registry of core queries and their SQL."""

from __future__ import annotations

from packloom.plans import dataset_queries, general, graph_queries, join_queries, metric_queries, report_queries, retrieval_queries, vector_queries

MODULES = [general, retrieval_queries, graph_queries, metric_queries, dataset_queries, join_queries, report_queries, vector_queries]


def queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {name: s for m in MODULES for name, s in m.SQL.items()}
