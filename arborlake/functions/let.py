"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it.

    When Spark pushes a filter below the projection that made a column, it puts the column's
    whole expression in every place where its name stood. Values bound by a lambda are not
    copied, so expensive steps used several times are bound here.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
