"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ["scoring", "aggregating", "joining", "ranking", "testing", "text", "source", "report", "streaming"]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}_queries")


def all_queries():
    _load()
    from .registry import QUERIES
    return dict(QUERIES)


def all_oracles():
    _load()
    from .registry import ORACLES
    return dict(ORACLES)
