"""All queries of the core, with their SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "operators.text_queries", "operators.context", "operators.detection", "operators.documents", "operators.jobs", "operators.image_queries",
    "plans.pipeline", "streaming.jobs",
]


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"pageloom.{name}").QUERIES
    return out


def queries() -> dict:
    """Each operator's query: (session, folder) -> DataFrame."""
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict:
    """SQL for the queries that it can express."""
    return {k: sql for k, (_, sql) in _all().items() if sql}
