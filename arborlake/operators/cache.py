"""Incremental state: probing, last-wins merging and upkeep of a cache table."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlake.functions.jsontext import strict_json
from arborlake.operators.ordering import newest_rows
from arborlake.options import CACHE_KEEP_SHARE, CACHE_LIMIT_MIB, MIB

STAT_KEYS = ("path", "size", "mtime_us")


def readable(cache: DataFrame) -> DataFrame:
    """Rows whose payload is valid JSON; any other row counts as a miss."""
    return cache.filter(strict_json(F.col("file_info")).isNotNull())


def unreadable(cache: DataFrame) -> DataFrame:
    return cache.filter(strict_json(F.col("file_info")).isNull())


def _lead(root: str) -> str:
    return root.rstrip("/") + "/" if root else ""


def of_root(cache: DataFrame, root: str) -> DataFrame:
    """Stored rows below ``root``, with paths relative to it. Tables hold full paths, so that
    trees with equal relative paths can share one."""
    lead = _lead(root)
    return cache.filter(F.startswith("path", F.lit(lead))).withColumn(
        "path", F.substr("path", F.lit(len(lead) + 1)))


def with_root(rows: DataFrame, root: str) -> DataFrame:
    """Rows to store, with full paths."""
    return rows.withColumn("path", F.concat(F.lit(_lead(root)), "path"))


def probe_keys(validate: str) -> list[str]:
    if validate not in ("stat", "hash"):
        raise ValueError(f"validate must be 'stat' or 'hash', not {validate!r}")
    return list(STAT_KEYS) + (["file_hash"] if validate == "hash" else [])


def hits(files: DataFrame, cache: DataFrame, validate: str = "stat") -> DataFrame:
    """Files whose stored result can be reused: equal path, size and mtime.

    ``validate="hash"`` also compares ``file_hash``, which then must be a column of ``files``.
    Pass metadata columns only; content is read later, for the misses.
    """
    return files.join(readable(cache), probe_keys(validate), "inner")


def misses(files: DataFrame, cache: DataFrame, validate: str = "stat") -> DataFrame:
    """Files to process: unknown, changed, or with an unreadable stored result."""
    keys = probe_keys(validate)
    return files.join(readable(cache).select(*keys), keys, "left_anti")


def spans(rows: DataFrame, column: str, parts: int = 64) -> list[tuple[int, int]]:
    """At most ``parts`` ranges that together hold every value of an integer column, nulls aside."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return []
    part = F.floor((F.col(column).cast("double") - float(low)) / float((high - low) // parts + 1))
    found: list[tuple[int, int]] = []
    before = None
    for number, first, last in sorted(
        rows.filter(F.col(column).isNotNull()).groupBy(part).agg(F.min(column), F.max(column)).collect()
    ):
        if before is not None and number == before + 1:
            found[-1] = (found[-1][0], last)
        else:
            found.append((first, last))
        before = number
    return found


def within(column: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a value lies in one of the ranges."""
    return functools.reduce(
        operator.or_, [(column >= first) & (column <= last) for first, last in ranges], F.lit(False))


def orphans(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Stored rows whose file is gone."""
    return cache.join(files.select("path"), "path", "left_anti")


def without_orphans(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("path"), "path", "left_semi")


def persistable(entries: DataFrame) -> DataFrame:
    """Results worth keeping: read files with a hash."""
    return entries.filter(F.col("type").isin("text", "binary") & F.col("hash").isNotNull())


def last_wins(rows: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """Newest row per key. Filtering row_number to 1 lets Spark keep one row per key and map
    task before the shuffle, so a key written very often is not gathered in one place."""
    newest = Window.partitionBy(key).orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def upsert(current: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """``changes`` replace rows of ``current`` with the same key.

    Within ``changes`` the last row must be unique per key already (see ``last_wins``).
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return last_wins(both, key, F.col("_new").desc()).drop("_new")


def upsert_keeping_position(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Replace by id: the latest values, at the position of the id's first appearance."""
    payload = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(
        F.min(seq).alias("position"),
        F.max_by(F.struct(*payload), F.col(seq)).alias("_last"),
    ).select(key, "position", *[f"_last.{c}" for c in payload if c != seq])


def accounting(cache: DataFrame) -> DataFrame:
    """Rows and payload bytes."""
    return cache.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.octet_length("file_info").cast("long")), F.lit(0)).alias("bytes"),
    )


def rows_to_keep(row_count: int, size_bytes: int, limit_bytes: int) -> int:
    """All rows below the limit, else the share that brings the size to 75 % of it."""
    if size_bytes <= limit_bytes:
        return row_count
    return int(row_count * (limit_bytes * CACHE_KEEP_SHARE) / size_bytes)


def evict(
    cache: DataFrame, limit_bytes: int = CACHE_LIMIT_MIB * MIB, size_bytes: int | None = None
) -> DataFrame:
    """Keep the newest rows by mtime once the table is over its limit.

    The cut is found in the keys alone, by a quantile sketch and the order of the few rows around it
    (``ordering.newest_rows``), and payloads move once, for the rows that stay.
    ``size_bytes`` may give the size on disk; the default is the payload size.
    """
    row_count, payload = accounting(cache).first()
    measured = payload if size_bytes is None else size_bytes
    keep = rows_to_keep(row_count, measured, limit_bytes)
    if keep == row_count:
        return cache
    newest = newest_rows(cache.select("mtime_us", "path"), keep).select("path")
    return cache.join(newest, "path", "left_semi")
