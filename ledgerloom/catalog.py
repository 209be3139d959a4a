"""Queries of the statement operators, and their DuckDB SQL."""

from __future__ import annotations

from .plans import (
    findings_queries, form_queries, intake_queries, layout_queries, model_queries, recovery_queries, statement_queries, text_queries,
)

_PARTS = [
    statement_queries, text_queries, layout_queries, form_queries, recovery_queries, model_queries, findings_queries, intake_queries,
]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
