"""Naming a subexpression inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a ``value`` that is evaluated once.

    The optimizer merges projections, so an array that a lambda refers to would be computed again for
    each element. Bound as a lambda's variable it is computed once a row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
