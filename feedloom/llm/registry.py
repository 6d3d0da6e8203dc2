"""All registered queries of this package."""

from __future__ import annotations


def load():
    """Queries and SQL counterparts by name."""
    from feedloom.llm.queries import REGISTRY

    return dict(REGISTRY.queries), dict(REGISTRY.oracles)
