"""Name an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it.

    Plain Column reuse repeats the expression at every mention, and generated code grows with it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
