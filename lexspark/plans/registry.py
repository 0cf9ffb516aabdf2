"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from lexspark.plans import evaluation, files_and_streams, full_audit, graph, retrieval, text_rules, verification

MODULES = [files_and_streams, text_rules, retrieval, graph, verification, full_audit, evaluation]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
