"""The registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from packloom.llm import answer_queries, corpus_queries

MODULES = [answer_queries, corpus_queries]


def queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {name: s for m in MODULES for name, s in m.SQL.items()}
