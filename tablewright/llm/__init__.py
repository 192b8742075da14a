"""Operators for preparing training data; each module holds one operator, its query and its SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "substring", "pieces", "chat", "warc", "mixing", "lpf", "packing", "quality", "permutation", "simhash",
    "mbs", "repair", "merkle",
]


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(importlib.import_module(f"{__name__}.{module}"), name, {}))
    return found


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
