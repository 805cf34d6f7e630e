"""Registered queries over the supplied tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scores", "prepare", "partitions", "neighbours", "synthesis", "explanations",
           "groups", "ledgers", "storage")


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        entries = getattr(import_module(f"suite.{module}"), name)
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        found.update(entries)
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
