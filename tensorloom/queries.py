"""All queries of the engine proper, and their DuckDB text."""

from __future__ import annotations

from tensorloom import catalog_bound, catalog_correlators, catalog_diagrams, catalog_fields, catalog_sources, catalog_symbolic

MODULES = [catalog_correlators, catalog_symbolic, catalog_fields, catalog_diagrams, catalog_sources, catalog_bound]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
