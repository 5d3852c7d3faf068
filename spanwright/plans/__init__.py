"""Whole runs built from the operators, and the registered queries."""

from __future__ import annotations

from . import flagship, logs, records, registry, runs, texts  # noqa: F401  (importing registers)


def all_queries():
    return {name: registry.bound(name) for name in registry.QUERIES}


def all_sql():
    return dict(registry.SQL)
