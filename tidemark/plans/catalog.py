"""All queries of the analytics engine and their SQL."""

from __future__ import annotations

from tidemark.plans import analytics, commerce, content, durable, loading

MODULES = (commerce, analytics, content, loading, durable)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
