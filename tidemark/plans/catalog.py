"""Imports every plan module so that its queries are registered."""

import importlib
import pkgutil

import tidemark.plans as _plans
from tidemark.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__)):
    if _module not in ("catalog", "registry"):
        importlib.import_module(f"tidemark.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
