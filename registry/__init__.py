"""Queries over the supplied tables, one per operator, with the matching SQL."""

from __future__ import annotations

import importlib

GROUPS = [
    "scans", "profiles", "cleaning", "features", "windows", "statistics", "kpis", "drivers", "charts", "stars",
    "relations",
]


def all_queries() -> dict:
    found: dict = {}
    for group in GROUPS:
        found.update(importlib.import_module(f"{__name__}.{group}").QUERIES)
    return found


def all_oracles() -> dict:
    found: dict = {}
    for group in GROUPS:
        found.update(importlib.import_module(f"{__name__}.{group}").ORACLES)
    return found
