"""Queries by subject; each module has QUERIES: name to (function of spark and sf_dir, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("relational", "events", "texts", "retrieval", "functions", "markup", "content", "fulltext", "ingest", "changes", "clusters", "watch", "korean", "copies")


def catalogue() -> dict:
    """All queries of the library."""
    return {name: q for m in MODULES for name, q in importlib.import_module(f"fernloom.plans.{m}").QUERIES.items()}
