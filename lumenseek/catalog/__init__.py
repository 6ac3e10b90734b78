"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("search", "text", "scan", "chunks", "index")


def _collect(name: str) -> dict:
    merged: dict = {}
    for module in _MODULES:
        part = getattr(importlib.import_module(f"lumenseek.catalog.{module}"), name)
        overlap = merged.keys() & part.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
