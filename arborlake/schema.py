"""Explicit schemas; nothing in the library infers one."""

from __future__ import annotations

FILES = (
    "path STRING, parent STRING, filename STRING, size BIGINT, mtime_us BIGINT, "
    "created_us BIGINT, mode BIGINT, stat_error STRING"
)

ENTRIES = (
    "path STRING, parent STRING, filename STRING, type STRING, reason STRING, encoding STRING, "
    "content STRING, preview_bytes BIGINT, truncated BOOLEAN, size BIGINT, created STRING, "
    "modified STRING, permissions STRING, timezone STRING, hash STRING, "
    "exception_type STRING, exception_message STRING"
)

ENTRY_COLUMNS = tuple(column.split(" ")[0] for column in ENTRIES.split(", "))

INFO_FIELDS = (
    "type", "reason", "encoding", "content", "preview_bytes", "truncated", "size", "created",
    "modified", "permissions", "timezone", "exception_type", "exception_message",
)

CACHE = (
    "path STRING, file_hash STRING, file_info STRING, size BIGINT, mtime_us BIGINT"
)

RUNS = (
    "identifier STRING, display_name STRING, ts TIMESTAMP_NTZ, repository STRING, preset STRING, "
    "output_format STRING, duration_seconds DOUBLE, processed_files BIGINT, total_files BIGINT, "
    "excluded_files BIGINT, failed_files BIGINT, stopped_early BOOLEAN, hash_algorithm STRING, "
    "configuration STRING, results STRING"
)

RUN_SUMMARY_FIELDS = (
    "total_files", "excluded_files", "failed_files", "stopped_early", "hash_algorithm",
)

LOGS = (
    "seq BIGINT, ts TIMESTAMP_NTZ, level INT, level_name STRING, logger_name STRING, "
    "message STRING, formatted STRING"
)

ISSUES = "number BIGINT, title STRING, body STRING, pull_request VARIANT"
