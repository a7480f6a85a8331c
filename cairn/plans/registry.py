"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from . import ingest, more, search

QUERIES = {**search.QUERIES, **ingest.QUERIES, **more.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def flagship(spark, sf_dir: str):
    return search.hybrid_search(spark, sf_dir)
