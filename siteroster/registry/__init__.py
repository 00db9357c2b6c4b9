"""All registered queries with their SQL statements."""

from __future__ import annotations

from importlib import import_module

MODULES = ["scalars", "tables", "extraction", "joins"]


def entries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"siteroster.registry.{name}").ENTRIES)
    return found
