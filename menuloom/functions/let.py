"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses
    it. Without this, merging projections and pushing filters copies a long chain
    of expressions into each use and the plan grows exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
