"""Imports every query module so their registrations run, then exposes them."""

from __future__ import annotations

import importlib

_MODULES = (
    "riskloom.plans.queries_data",
    "riskloom.plans.queries_features",
    "riskloom.plans.queries_metrics",
    "riskloom.plans.queries_prep",
    "riskloom.plans.queries_models",
    "riskloom.plans.queries_io",
    "riskloom.plans.queries_stream",
)


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def queries():
    _load()
    from riskloom.plans.catalog import QUERIES
    return dict(QUERIES)


def oracle_sql():
    _load()
    from riskloom.plans.oracle import SQL
    from riskloom.plans.catalog import QUERIES
    return {k: v for k, v in SQL.items() if k in QUERIES}
