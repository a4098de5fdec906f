"""A whole run over a directory tree: scan, reuse, analyse, export, record."""

from __future__ import annotations

import dataclasses
import datetime
import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake import sinks
from arborlake.functions.content import algorithm_used
from arborlake.operators import analysis, summary
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse_incremental, stored_form
from arborlake.schema import ENTRY_COLUMNS, RUNS
from arborlake.session import materialise
from arborlake.sources import content, filetree
from arborlake.sources.cache_table import CacheTable
from arborlake.sources.state_table import StateTable


@dataclass(frozen=True)
class TreeRun:
    """What a run left: its id, the written entries, the one-row summary and the failures."""

    identifier: str
    entries: DataFrame
    summary: DataFrame
    failures: DataFrame


def cache_table(spark: SparkSession, path: str, **options) -> CacheTable:
    return CacheTable(spark, path, **options)


def history_table(spark: SparkSession, path: str) -> StateTable:
    return StateTable(spark, path, RUNS, "identifier")


def run_tree(
    spark: SparkSession,
    root: str,
    target: str,
    fmt: str = "json",
    options: ScanOptions | None = None,
    *,
    include_summary: bool = True,
    state: CacheTable | None = None,
    history: StateTable | None = None,
    preset: str | None = None,
    name: str | None = None,
    scan_options: dict | None = None,
    by_levels: bool = False,
    upkeep: dict | None = None,
    drop_orphans: bool = False,
    **sink_options,
) -> TreeRun:
    """Analyse the files below ``root`` and write them to ``target`` as ``fmt``.

    The listing and the entries are each written once in the shared folder, so no file is
    listed or read twice although summary, export, state and history all use them. With a
    ``state`` unchanged files are not opened; with a ``history`` the run is recorded.
    The state is then kept in bounds (``CacheTable.upkeep``, whose limits ``upkeep`` may give), and
    ``drop_orphans`` also forgets files that are gone. ``by_levels`` lists very uneven trees level by level (see ``filetree.scan_levels``).
    """
    options = options or ScanOptions()
    started = time.monotonic()
    when = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    identifier = uuid.uuid4().hex
    home = root if "://" in root else os.path.abspath(root)

    scan = filetree.scan_levels if by_levels else filetree.scan
    listed = materialise(scan(spark, root, options, **(scan_options or {})), "listing")
    reached = analysis.traversed(listed, options)
    if state is None:
        included = reached.filter(~F.col("name_excluded"))
        made = analysis.entries(
            content.with_content(included, options), options, keep=["mtime_us"]
        ).withColumn("from_state", F.lit(False))
    else:
        made = analyse_incremental(
            listed, state.below(home), options, lambda files: content.with_content(files, options)
        ).entries
    kept = materialise(made, "entries")
    entries = kept.select(*ENTRY_COLUMNS)

    skipped = reached.filter("name_excluded").select(
        "name_excluded", F.lit(None).cast("string").alias("type"))
    counted = entries.select(F.lit(False).alias("name_excluded"), "type").unionByName(skipped)
    totals = materialise(
        summary.run_summary(counted, hash_algorithm=algorithm_used(options.hash_algorithm)),
        "summary")
    failures = summary.failures(entries)
    sinks.write(
        fmt, entries, target,
        **({"summary": totals, "failures": failures} if include_summary else {}), **sink_options)

    if state is not None:
        state.below(home).upsert(stored_form(kept.filter("NOT from_state")), identifier)
        state.upkeep(listed if drop_orphans else None, home, identifier, **(upkeep or {}))
    if history is not None:
        row = totals.select(
            F.lit(identifier).alias("identifier"),
            F.lit(name or f"Analysis {identifier[:8]}").alias("display_name"),
            F.lit(when).cast("timestamp_ntz").alias("ts"),
            F.lit(root).alias("repository"),
            F.lit(preset).cast("string").alias("preset"),
            F.lit(fmt).alias("output_format"),
            F.lit(time.monotonic() - started).alias("duration_seconds"),
            "processed_files", "total_files", "excluded_files", "failed_files", "stopped_early",
            "hash_algorithm",
            F.lit(json.dumps(dataclasses.asdict(options), sort_keys=True)).alias("configuration"),
            F.lit(target).alias("results"),
        )
        history.upsert(row, identifier)
    return TreeRun(identifier, entries, totals, failures)
