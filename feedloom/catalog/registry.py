"""All registered queries."""

from __future__ import annotations

import importlib

PARTS = ("scalars", "rows", "duplicates", "landed", "composites")


def load():
    """Queries and SQL counterparts by name."""
    queries, oracles = {}, {}
    for part in PARTS:
        registry = importlib.import_module(f"feedloom.catalog.{part}").REGISTRY
        clash = queries.keys() & registry.queries.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        queries.update(registry.queries)
        oracles.update(registry.oracles)
    return queries, oracles
