"""Collects the registered queries and their SQL from the plan modules."""

from __future__ import annotations

import importlib

#: Modules of this package that define ``QUERIES`` and ``SQL``.
MODULES = ["columns", "statistics", "hierarchy", "edits", "sets", "evaluation", "connectors", "more", "masks", "reports"]


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"{__package__}.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
