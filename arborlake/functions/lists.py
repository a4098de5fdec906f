"""Array functions on exclusion-rule lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_union(left: Column, right: Column) -> Column:
    """Both lists in order, each value once, at its first place."""
    return F.array_distinct(F.concat(left, right))


def without(values: Column, removed: Column) -> Column:
    """Values not listed in ``removed``; repeated values stay repeated."""
    return F.filter(values, lambda v: ~F.array_contains(removed, v))
