"""All queries on data for language models and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from hunkyard.llm import queries as _package

MODULES = [importlib.import_module(f"{_package.__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(_package.__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
