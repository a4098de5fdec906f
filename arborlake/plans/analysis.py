"""An analysis run from a files table to entries, summary and failures."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from arborlake.functions.content import algorithm_used, content_hash
from arborlake.operators import analysis, cache, summary
from arborlake.options import ScanOptions
from arborlake.schema import ENTRIES, ENTRY_COLUMNS
from arborlake.sources.cache_table import RootedCache


class Analysis:
    """Results of one run; each plan is made when it is first asked for."""

    def __init__(self, files: DataFrame, options: ScanOptions):
        self.options = options
        self.reached = analysis.traversed(files, options)

    @functools.cached_property
    def rows(self) -> DataFrame:
        """All reached files with ``name_excluded``, ``type`` and ``reason``."""
        return analysis.tagged(self.reached, self.options)

    @functools.cached_property
    def entries(self) -> DataFrame:
        return analysis.entries(self.reached.filter(~F.col("name_excluded")), self.options)

    def summary(self, *, stopped_early: bool = False) -> DataFrame:
        """Counts over all reached files, from names and metadata alone."""
        return summary.run_summary(
            self.reached, failed=analysis.is_failed(self.reached, self.options),
            stopped_early=stopped_early,
            hash_algorithm=algorithm_used(self.options.hash_algorithm),
        )

    def failures(self) -> DataFrame:
        """``file, error`` rows; picked by metadata before any entry is made."""
        failed = analysis.is_failed(self.reached, self.options)
        picked = self.reached.filter(~F.col("name_excluded") & failed)
        return summary.failures(analysis.entries(picked, self.options))


def analyse(files: DataFrame, options: ScanOptions) -> Analysis:
    """``files`` has the FILES columns and ``content``."""
    return Analysis(files, options)


@dataclass(frozen=True)
class Incremental:
    """``entries`` is both parts together, with ``mtime_us`` and the flag ``from_state``."""

    entries: DataFrame
    reused: DataFrame
    processed: DataFrame


def stored_form(entries: DataFrame) -> DataFrame:
    """Entries as cache rows: the info as JSON text, keyed by path, size and mtime."""
    payload = [n for n in ENTRY_COLUMNS if n not in ("path", "hash")]
    return cache.persistable(entries).select(
        "path", F.col("hash").alias("file_hash"), F.to_json(F.struct(*payload)).alias("file_info"),
        "size", "mtime_us",
    )


def _hashed(files: DataFrame, options: ScanOptions) -> DataFrame:
    if "digest" in files.columns:
        return files.withColumn("file_hash", F.col("digest"))
    return files.withColumn(
        "file_hash", content_hash(F.col("content"), options.hash_algorithm or "xxh64"))


def analyse_incremental(
    files: DataFrame,
    stored: DataFrame | RootedCache,
    options: ScanOptions,
    load_content: Callable[[DataFrame], DataFrame],
) -> Incremental:
    """Reuse stored results of unchanged files and read only the others.

    ``files`` is metadata only; ``stored`` is a table of ``CACHE`` rows or the state of a tree
    (``CacheTable.below``), which is probed by its key index. ``load_content`` adds ``content`` to the rows it is given (see
    ``sources.content``); it gets the misses alone, so unchanged files are never opened. With
    ``cache_validate="hash"`` every file within the size limit is read, as its hash is compared.
    """
    reached = analysis.traversed(files, options).filter(~F.col("name_excluded"))
    # a file without a size is no smaller one: its stat failed, and it has nothing to read
    unread = F.coalesce(analysis.size_excluded(F.col("size"), options), F.lit(False)) | F.col("stat_error").isNotNull()
    in_size = reached.filter(~unread)
    if isinstance(stored, DataFrame):
        find, miss = functools.partial(cache.hits, cache=stored), functools.partial(cache.misses, cache=stored)
    else:
        find, miss = stored.hits, stored.misses
    if options.cache_validate == "hash":
        in_size = _hashed(load_content(in_size), options)
        hits = find(in_size.drop("content", "digest", "read_error"), validate="hash")
        fresh = miss(in_size, validate="hash").drop("file_hash")
    else:
        hits = find(in_size, validate=options.cache_validate)
        fresh = load_content(miss(in_size, validate=options.cache_validate))
    parsed = F.from_json("file_info", ENTRIES)
    reused = hits.withColumn("_info", parsed).select(
        *[n if n in ("path", "parent", "filename") else F.col("file_hash").alias("hash") if n == "hash"
          else F.col(f"_info.{n}").alias(n) for n in ENTRY_COLUMNS],
        "mtime_us",
    )
    skipped = reached.filter(unread).withColumn("content", F.lit(None).cast("binary"))
    processed = analysis.entries(
        fresh.unionByName(skipped, allowMissingColumns=True), options, keep=["mtime_us"]
    )
    both = reused.withColumn("from_state", F.lit(True)).unionByName(
        processed.withColumn("from_state", F.lit(False)))
    return Incremental(both, reused, processed)
