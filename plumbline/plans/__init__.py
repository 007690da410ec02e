"""Registered queries, grouped by subject in the `q_*` modules."""

import importlib
import pkgutil


def load_all():
    """Import every `q_*` module and return (queries, oracles)."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    from plumbline.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
