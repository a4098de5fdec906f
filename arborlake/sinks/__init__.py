"""Exports. Every sink takes entries and an optional summary, and writes part files in order."""

from arborlake.sinks.documents import SINKS, write

__all__ = ["SINKS", "write"]
