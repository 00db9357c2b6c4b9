"""The queries of the operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["centroids", "conversations", "decontamination", "html", "licenses", "lines", "lm_scoring", "packing", "quality",
           "resampling", "secrets", "simhash", "suffix"]


def entries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"siteroster.llm.queries_{name}").ENTRIES)
    return found
