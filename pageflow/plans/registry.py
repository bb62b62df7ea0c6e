"""Queries of the page, batch and naming operators with their DuckDB text."""

from __future__ import annotations


def queries() -> dict:
    from pageflow.plans.queries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from pageflow.plans.oracle import ORACLE

    return dict(ORACLE)
