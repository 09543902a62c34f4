"""The registered queries: each module here has QUERIES and ORACLES, keyed alike."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("text_queries", "graph_queries", "relational_queries", "pattern_queries", "code_queries", "source_queries", "repository_queries", "packing_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"sparkloom.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
