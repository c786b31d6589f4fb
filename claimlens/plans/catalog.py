"""All registered queries. Importing this module fills ``REGISTRY``."""

from __future__ import annotations

from claimlens.plans import queries_dashboard, queries_features, queries_io, queries_metrics, queries_ml, queries_search  # noqa: F401
from claimlens.plans.registry import REGISTRY


def queries():
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql():
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}


def bench_keys():
    return [k for k, e in REGISTRY.items() if e.bench]


def long_keys():
    """Queries that train many models."""
    return [k for k, e in REGISTRY.items() if e.long]
