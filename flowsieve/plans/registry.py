"""The query catalog: name -> Spark callable (spark, sf_dir) and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` (DuckDB dialect over the driver views) is its oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    """Import every plan module so their queries register themselves."""
    from flowsieve.plans import (q_clean, q_eval, q_io, q_models, q_reports,  # noqa: F401
                                 q_sampling, q_stats, q_stream, q_vectors)
    return QUERIES, ORACLE
