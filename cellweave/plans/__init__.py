"""Named queries, grouped by family, each next to the SQL it is checked against."""

from __future__ import annotations

import importlib

FAMILIES = ["areas", "grid", "blocks", "release", "flows", "texts", "repair", "tables", "learning"]


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in FAMILIES]


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
