"""Registered queries by subject."""
from __future__ import annotations

import importlib
import pkgutil

from gridledger.queries import base


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")


def all_queries() -> dict[str, base.Query]:
    _load()
    return base.QUERIES


def all_oracles() -> dict[str, str]:
    _load()
    return base.ORACLES
