"""Exports of single runs and of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions.escape import canonical_json
from arborlake.functions.times import run_time
from arborlake.operators import runs as run_ops


def run_json(
    runs: DataFrame, *, documents: tuple[str, ...] = (), pretty: bool = False
) -> DataFrame:
    """Each run as one JSON text with sorted keys: ``identifier, document``.

    ``documents`` names text columns that hold JSON themselves; they become nested objects.
    """
    columns: dict[str, Column] = {
        name: F.try_parse_json(name) if name in documents else F.col(name)
        for name in runs.columns if name != "ts"
    }
    columns["timestamp"] = F.replace(run_time(F.col("ts")), F.lit(" "), F.lit("T"))
    return runs.select("identifier", canonical_json(columns, pretty=pretty).alias("document"))


def write_runs(runs: DataFrame, path: str, **options) -> None:
    run_json(runs, **options).select("document").write.text(path)


def write_reports(runs: DataFrame, path: str, summary_columns: tuple[str, ...] = ()) -> None:
    lines = run_ops.report_lines(runs, summary_columns)
    lines.orderBy("identifier", "section", "position").select("line").write.text(path)


def write_log_text(logs: DataFrame, path: str) -> None:
    """Formatted log lines in time order."""
    logs.orderBy("ts", "seq").select("formatted").write.text(path)
