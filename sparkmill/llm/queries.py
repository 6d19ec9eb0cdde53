"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "bpe", "vectors", "toxicity", "tokencount", "tokenfile", "media", "simhash", "sharding", "language")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
