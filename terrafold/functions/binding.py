"""Evaluate an expression once and use it inside lambdas.

A lambda over an array evaluates everything it mentions for every element, so
an expression from outside is bound to a lambda variable first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where ``use`` refers to it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
