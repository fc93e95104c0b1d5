"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("bpe", "token_files", "licenses", "quality", "decontaminate", "simhash", "warc", "chat", "pii", "suffix_dedup", "fill_middle", "vector_codes", "pipeline")


def _modules():
    return [importlib.import_module(f"panelspark.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in (getattr(m, "ORACLE_SQL", None) or {}).items()}
