"""Operators for training data. Nothing outside this package imports it."""

from __future__ import annotations

import importlib
import pkgutil


def _collected(name: str) -> dict:
    out: dict = {}
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        out |= getattr(importlib.import_module(f"{__name__}.{m}"), name, {})
    return out


def queries() -> dict:
    """The pN_ queries of all modules."""
    return _collected("QUERIES")


def oracle_sql() -> dict:
    """SQL of those queries that SQL can express."""
    return _collected("ORACLES")
