"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("panel", "joining", "grouping", "evaluating", "testing", "modelling", "publishing")


def _each(attribute: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__name__}.{m}"), attribute).items()}


def queries() -> dict[str, Callable]:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("ORACLE_SQL")
