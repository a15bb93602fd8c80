"""Registered queries over the supplied tables."""

from __future__ import annotations

from importlib import import_module

from .catalog import REGISTRY, Query

_MODULES = [
    "coverage_queries", "profile_queries", "cleaning_queries", "metric_queries", "sampling_queries", "evidence_queries",
    "ledger_queries", "report_queries", "flagship", "model_queries", "store_queries",
]


def all_queries() -> dict[str, Query]:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
    return dict(REGISTRY)
