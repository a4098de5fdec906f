"""Catalogue: one query per operator over the supplied tables, with SQL for the cross-check."""

from arborlake.plans.catalog import corpus, exports, history, state, streams  # noqa: F401
from arborlake.plans.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
