"""All registered queries and their SQL checks."""

from __future__ import annotations

import importlib

_MODULES = ["versions", "text", "extraction", "advisories", "matching", "usage", "profile", "risk", "graph", "remediation", "reports", "serving", "jobs", "plugins"]


def groups():
    found = []
    for name in _MODULES:
        try:
            found.append(importlib.import_module(f"fleetlens.catalog.{name}").GROUP)
        except ModuleNotFoundError as missing:
            if missing.name != f"fleetlens.catalog.{name}":
                raise
    return found


def all_queries() -> dict:
    return {name: fn for g in groups() for name, fn in g.queries.items()}


def all_oracles() -> dict:
    return {name: sql for g in groups() for name, sql in g.oracles.items()}
