"""Runnable queries over the given tables, one per operator of the engine."""
from __future__ import annotations

import importlib

MODULES = ["texts", "sections", "lines", "coding", "mentions", "evidence", "mapping", "replies", "status", "coverage", "strict", "terms", "plans"]


def load():
    """Import every catalog module and return the registry."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry
