"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

_MODULES = ["confirm", "learner", "archive", "selection", "classification", "training", "clustering", "corpus", "decide", "concepts", "io"]


def load_all():
    """Import every query module and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"veritab.plans.{name}")
    return importlib.import_module("veritab.plans.registry")
