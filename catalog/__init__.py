"""Bindings of the operators to the given tables."""

from __future__ import annotations

import importlib

MODULES = ("files", "quality", "statistics", "comparison", "joining", "spatial", "scoring", "ordering", "sampling", "auditing", "composites")


def load():
    from catalog.registry import ORACLES, QUERIES

    for m in MODULES:
        importlib.import_module(f"catalog.{m}")
    return QUERIES, ORACLES
