"""Every registered query: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["search", "aggregates", "collection", "joins", "similarity", "interchange", "ingest", "streams", "lists"]


def registry() -> dict:
    held = {}
    for name in MODULES:
        for key, pair in import_module(f"{__name__}.{name}").QUERIES.items():
            assert key not in held, key
            held[key] = pair
    return held
