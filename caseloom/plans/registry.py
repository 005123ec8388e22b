"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["graph_queries", "text_queries", "document_queries", "search_queries", "retrieval_queries", "resolution_queries", "evaluation_queries", "flow_queries", "evidence_queries"]


def _collect(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"caseloom.plans.{module}"), name).items():
            if key in merged:
                raise ValueError(f"query {key} is registered twice")
            merged[key] = value
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
