"""Registry of named queries: a Spark plan and, where SQL can state it, an
independent DuckDB answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.plans.context import Inputs
from tessera.plans.oracle_base import with_prelude

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_BODIES: dict[str, tuple[str, dict[str, str] | None]] = {}


def register(key: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a Spark query under ``key``; ``sql`` (DuckDB, over the
    prelude tables) is its oracle, omitted for rows-only checks."""

    def deco(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            _BODIES[key] = (sql, extra)
        return fn

    return deco


def oracle() -> dict[str, str]:
    """Oracle SQL per key, composed after every prelude table is known."""
    load_all()
    return {k: with_prelude(sql, extra) for k, (sql, extra) in _BODIES.items()}


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from tessera.plans import oracle_funding, oracle_graph, oracle_orgs, oracle_patents  # noqa: F401
    from tessera.plans import q_extra, q_funding, q_geo, q_graph, q_io, q_orgrel, q_patents, q_quality, q_registry, q_topics  # noqa: F401
