"""Input tables and registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module and return the registry."""
    from newsweave.plans import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry
