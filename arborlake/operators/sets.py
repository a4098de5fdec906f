"""Set operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def key_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct keys of both sides in order."""
    return left.union(right).distinct().orderBy(*left.columns)
