"""Computing an intermediate value once: inside one expression, or for a whole row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    A lambda variable is the one place Spark evaluates an expression exactly
    once per row, inside other lambdas included.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns the optimizer will not copy into later filters and projections.

    A filter on a computed column is pushed below the projection that computes
    it by repeating the expression; for a JSON parse that means parsing again
    for every mention. A generator over a one-element array is never crossed
    that way, streams like any projection and stays inside code generation.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
