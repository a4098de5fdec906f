"""Registration of queries and the shared SQL views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.functions.classify import BINARY_SUFFIXES, TEXT_SUFFIXES
from arborlake.options import ScanOptions
from arborlake.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Options of the catalogue's analysis run. Charset analysis is off and the hash is md5, as SQL
# has neither; ``classify_with_charset`` and ``content_hash_xxh64`` run the other way.
OPTIONS = ScanOptions(
    excluded_files=("f7", "f12.png", "config.json"),
    exclude_patterns=("*.tmp", r"regex:f\d+5\.md"),
    max_file_size=20_000,
    detect_charset=False,
    fallback_encoding="utf-8",
    hash_algorithm="md5",
)

# The whole table: no rule leaves out a file and none is too large. Exports, trees, state and streams use it.
WHOLE = ScanOptions(
    excluded_folders=(), excluded_files=(), exclude_patterns=(), detect_charset=False,
    fallback_encoding="utf-8", hash_algorithm="md5",
)
# Small limits, and binary files are read: every branch of an entry occurs.
SMALL = ScanOptions(
    excluded_folders=(), excluded_files=(), exclude_patterns=(), include_binary=True,
    max_file_size=20_000, text_preview_bytes=1000, binary_preview_bytes=500, detect_charset=False,
    fallback_encoding="utf-8", hash_algorithm="md5",
)

_SUFFIX = r"lower(regexp_extract(filename, '(?s)^.+(\.[^.]+)$', 1))"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_iso(micros: str, offset_minutes: int = 0) -> str:
    """ISO text of whole-second microseconds at a fixed offset."""
    sign = "-" if offset_minutes < 0 else "+"
    hours, minutes = divmod(abs(offset_minutes), 60)
    return (
        f"concat(strftime(make_timestamp({micros} + {offset_minutes * views.MINUTE_US}), "
        f"'%Y-%m-%dT%H:%M:%S'), '{sign}{hours:02d}:{minutes:02d}')"
    )


_SAMPLES = """samples_v AS (
  SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE printable / CAST(total AS DOUBLE) END AS printable_ratio,
    CASE WHEN total = 0 THEN 0.0 ELSE control / CAST(total AS DOUBLE) END AS control_ratio,
    CASE WHEN total = 0 THEN 0.0 ELSE nul / CAST(total AS DOUBLE) END AS nul_ratio
  FROM (
    SELECT doc_id, path, filename, h, CAST(len(b) AS BIGINT) AS total,
      CAST(len(list_filter(b, lambda x: x BETWEEN '20' AND '7E' OR x IN ('09','0A','0C','0D')))
        AS BIGINT) AS printable,
      CAST(len(list_filter(b, lambda x: x < '20' AND x NOT IN ('09','0A','0C','0D')))
        AS BIGINT) AS control,
      CAST(len(list_filter(b, lambda x: x = '00')) AS BIGINT) AS nul
    FROM (SELECT doc_id, path, filename, h, regexp_extract_all(h, '..') AS b
      FROM (SELECT doc_id, path, filename, hex((encode(text))[1:8192]) AS h FROM files_v))))"""

_DECISIONS = f"""decisions_v AS (
  SELECT *, coalesce(by_suffix, by_statistics, CASE WHEN mime = 'application/x-empty' THEN false
      WHEN mime <> 'application/octet-stream' THEN true END, false) AS is_binary
  FROM (
    SELECT *,
      CASE WHEN ext IN {sql_list(TEXT_SUFFIXES)} THEN false
        WHEN ext IN {sql_list(BINARY_SUFFIXES)} THEN true END AS by_suffix,
      CASE WHEN nul_ratio > 0 AND (nul_ratio >= 0.001 OR contains(h, '0000')) THEN true
        WHEN control_ratio > 0.10 AND printable_ratio < 0.9 THEN true
        WHEN printable_ratio >= 0.95 AND control_ratio <= 0.02 THEN false
        WHEN printable_ratio <= 0.60 THEN true END AS by_statistics,
      CASE WHEN h = '' THEN 'application/x-empty' WHEN h LIKE '25504446%' THEN 'application/pdf'
        WHEN h LIKE '504B0304%' THEN 'application/zip'
        WHEN h LIKE '425A68%' THEN 'application/x-bzip2' WHEN h LIKE '52494646%' THEN
        'application/x-riff' WHEN h LIKE '4F676753%' THEN 'audio/ogg'
        WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'image/gif'
        ELSE 'application/octet-stream' END AS mime
    FROM (SELECT *, {_SUFFIX} AS ext FROM samples_v)))"""

_REACHED = f"""reached_v AS (
  SELECT *, filename IN {sql_list(OPTIONS.excluded_files)} OR filename LIKE '%.tmp'
      OR regexp_matches(filename, '^(?:f\\d+5\\.md)') AS name_excluded
  FROM files_v
  WHERE NOT list_has_any(string_split(parent, '/'), {sql_array(OPTIONS.excluded_folders)})
    AND NOT list_bool_or(list_transform(string_split(parent, '/'),
      lambda x: x LIKE '%.tmp' OR regexp_matches(x, '^(?:f\\d+5\\.md)'))))"""


def _tagged(name: str, files: str, options: ScanOptions) -> str:
    return f"""{name} AS (
  SELECT r.*, d.is_binary, {_SUFFIX.replace('filename', 'r.filename')} AS ext,
    CASE WHEN size > {options.max_file_size} THEN 'excluded'
      WHEN d.is_binary OR {_SUFFIX.replace('filename', 'r.filename')}
        IN {sql_list(options.image_extensions)} THEN 'excluded'
      ELSE 'text' END AS type,
    CASE WHEN size > {options.max_file_size} THEN 'file_size'
      WHEN d.is_binary OR {_SUFFIX.replace('filename', 'r.filename')}
        IN {sql_list(options.image_extensions)} THEN 'binary_or_image' END AS reason
  FROM {files} r JOIN decisions_v d USING (doc_id))"""


def _entries(name: str, rows: str) -> str:
    return f"""{name} AS (
  SELECT path, parent, filename, type, reason,
    CASE WHEN type = 'text' THEN CASE WHEN octet_length(encode(text)) = length(text)
      THEN 'ascii' ELSE 'utf_8' END END AS encoding,
    CASE WHEN type = 'text' THEN text END AS content,
    CASE WHEN type = 'text' THEN size END AS preview_bytes,
    CAST(NULL AS BOOLEAN) AS truncated,
    CASE WHEN type = 'text' OR reason = 'file_size' THEN size END AS size,
    CAST(NULL AS VARCHAR) AS created,
    CASE WHEN type = 'text' THEN {sql_iso('mtime_us')} END AS modified,
    CASE WHEN type = 'text' THEN printf('0o%o', mode) END AS permissions,
    CASE WHEN type = 'text' THEN 'UTC' END AS timezone,
    CASE WHEN type = 'text' THEN md5(text) END AS hash,
    CAST(NULL AS VARCHAR) AS exception_type, CAST(NULL AS VARCHAR) AS exception_message
  FROM {rows})"""


_TAGGED = _tagged("tagged_v", "reached_v", OPTIONS)
_ALL_TAGGED = _tagged("all_tagged_v", "files_v", WHOLE)
_ENTRIES = _entries("entries_v", "all_tagged_v")
_LIMITED = _entries("limited_entries_v", "tagged_v WHERE NOT name_excluded")

# toxic documents stand for files whose stat failed
_FAULTY = f"""faulty_v AS (
  SELECT f.*, t.doc_id IS NOT NULL AS failed,
    CASE WHEN t.doc_id IS NOT NULL THEN 'error' WHEN f.size > {SMALL.max_file_size} THEN 'excluded'
      WHEN d.is_binary THEN 'binary' ELSE 'text' END AS type
  FROM files_v f JOIN decisions_v d ON d.doc_id = f.doc_id
    LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = f.doc_id)"""

_DIRS = """dirs_v AS (
  SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END
      AS parent, list_extract(string_split(path, '/'), -1) AS name,
    CAST(len(string_split(path, '/')) AS BIGINT) AS depth
  FROM (
    SELECT DISTINCT unnest(list_transform(range(1, len(parts) + 1),
      lambda i: array_to_string(parts[1:i], '/'))) AS path
    FROM (SELECT DISTINCT string_split(parent, '/') AS parts FROM entries_v WHERE parent <> '')))"""


def _summary(name: str, rows: str, excluded: str) -> str:
    return f"""{name} AS (
  SELECT *, total_files - excluded_files AS included_files,
    CASE WHEN total_files = 0 THEN 0.0
      ELSE CAST(excluded_files AS DOUBLE) / total_files * 100 END AS excluded_percentage,
    CAST(0 AS BIGINT) AS failed_files, false AS stopped_early,
    total_files - excluded_files AS processed_files, 'md5' AS hash_algorithm
  FROM (SELECT count(*) AS total_files, count(*) FILTER ({excluded}) AS excluded_files
    FROM {rows}))"""


_SUMMARY = _summary("summary_v", "reached_v", "name_excluded")
_ALL_SUMMARY = _summary("all_summary_v", "files_v", "false")

VIEWS = {
    text.split(" AS ", 1)[0]: text
    for text in (
        views.FILES_SQL, views.CACHE_SQL, views.RUNS_SQL, views.LOGS_SQL, views.PAGES_SQL,
        views.URLS_SQL, views.REPO_FILES_SQL, _SAMPLES, _DECISIONS, _REACHED, _TAGGED, _ALL_TAGGED,
        _ENTRIES, _LIMITED, _FAULTY,
        _DIRS, _SUMMARY, _ALL_SUMMARY,
    )
}


def with_views(sql: str) -> str:
    """The query preceded by the views it uses, in dependency order."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+_v\b", text):
            if name in VIEWS and name not in used:
                visit(VIEWS[name].split(" AS ", 1)[1])
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    return "WITH " + ",\n".join(VIEWS[name] for name in used) + "\n" + sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked, and tests cover it."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return function

    return register
