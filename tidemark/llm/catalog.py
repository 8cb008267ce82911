"""The registered queries of this subpackage, with the reference SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = [
    "topk", "chat", "quality", "decontaminate", "line_dedup", "near_dup", "secrets", "mixing", "span_dedup", "lm",
    "rtree", "lexical", "bpe",
]


def _load():
    return [importlib.import_module(f"tidemark.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {name: fn for m in _load() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in _load() for name, text in m.ORACLES.items()}
