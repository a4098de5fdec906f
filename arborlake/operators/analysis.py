"""The per-file analysis as one cascade of columns over a files table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import classify, content as fc, times
from arborlake.functions.paths import suffix
from arborlake.operators import filters
from arborlake.options import ScanOptions


def traversed(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Drop what lies below excluded directories and flag name-excluded files.

    Files below an excluded directory are never counted; ``name_excluded`` ones are.
    """
    return files.filter(filters.reachable(F.col("parent"), options)).withColumn(
        "name_excluded", filters.name_excluded(F.col("filename"), options)
    )


def size_excluded(size: Column, options: ScanOptions) -> Column:
    return size > options.max_file_size


def is_image(filename: Column, options: ScanOptions) -> Column:
    images = [e.lower() for e in options.image_extensions]
    return suffix(filename).isin(*images) if images else F.lit(False)


def _read_error(files: DataFrame) -> Column:
    return F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")


def _problem(files: DataFrame) -> Column:
    """``ExceptionName: message`` of what kept a file from being read."""
    return F.coalesce(F.col("stat_error"), _read_error(files))


def is_failed(files: DataFrame, options: ScanOptions) -> Column:
    """True for files that end as error entries; needs no content."""
    unread = _read_error(files).isNotNull() & ~size_excluded(F.col("size"), options)
    return F.col("stat_error").isNotNull() | F.coalesce(unread, F.lit(False))


def _problem_text(files: DataFrame) -> Column:
    message = F.regexp_replace(_problem(files), "(?s)^[^:]*: ", "")
    kind = F.substring_index(_problem(files), ": ", 1)
    title = (
        F.when(F.col("stat_error").isNotNull(), F.lit("Failed to get file stats: "))
        .when(kind == "PermissionError", F.lit("Permission denied: "))
        .otherwise(F.lit("OS error: "))
    )
    return F.concat(title, message)


def tagged(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Add ``type`` (error, excluded, binary or text) and ``reason``.

    Size is judged before content, and content only where the suffix leaves the class open.
    """
    large = size_excluded(F.col("size"), options)
    rows = classify.with_is_binary(files, charset=options.detect_charset, unless=large)
    skipped = F.col("is_binary") | is_image(F.col("filename"), options)
    if options.include_binary:
        skipped = F.lit(False)
    tag = (
        F.when(F.col("stat_error").isNotNull(), F.lit("error"))
        .when(large, F.lit("file_size"))
        .when(_read_error(files).isNotNull(), F.lit("error"))
        .when(skipped, F.lit("binary_or_image"))
        .when(F.col("is_binary"), F.lit("binary"))
        .otherwise(F.lit("text"))
    )
    reasons = F.lit("^(file_size|binary_or_image)$")
    rows = rows.withColumn("_tag", tag)
    return rows.withColumns({
        "type": F.regexp_replace("_tag", reasons, F.lit("excluded")),
        "reason": F.regexp_substr("_tag", reasons),
    }).drop("_tag")


def entries(
    files: DataFrame, options: ScanOptions, keep: Sequence[str | Column] = ()
) -> DataFrame:
    """One entry per file: tag, bounded content, metadata and hash; ``keep`` adds own columns.

    ``files`` carries FILES columns plus ``content``; a loader that reads bounded content also
    brings ``digest`` (hash of the whole file) and ``read_error``. Excluded and error rows keep
    no content and no metadata, as only read files have them.
    """
    rows = tagged(files, options)
    is_text = F.col("type") == "text"
    is_bin = F.col("type") == "binary"
    read = is_text | is_bin
    limit = F.when(is_text, F.lit(options.text_limit)).otherwise(F.lit(options.binary_limit))
    limit = limit.cast("long")
    rows = rows.withColumn("_text", F.when(is_text, fc.preview(F.col("content"), options.text_limit)))
    rows = fc.with_decoded(
        rows, "_text", hint=fc.encoding_hint(options.encoding),
        cut=F.col("size") > options.text_limit, fallback=options.fallback_encoding,
    )
    raw_binary = F.when(is_bin, fc.preview(F.col("content"), options.binary_limit))
    if not options.hash_algorithm:
        digest = F.lit(None).cast("string")
    elif "digest" in files.columns:
        digest = F.when(read, F.col("digest"))
    else:
        digest = fc.content_hash(F.when(read, F.col("content")), options.hash_algorithm)
    problem = _problem(files)
    size_wanted = read | (F.col("reason") == "file_size")
    failed = F.col("type") == "error"
    return rows.select(
        "path",
        "parent",
        "filename",
        "type",
        "reason",
        F.when(is_text, F.col("_encoding")).when(is_bin, F.lit("base64")).alias("encoding"),
        F.when(is_text, F.col("_decoded"))
        .when(is_bin, fc.base64_text(raw_binary))
        .when(failed, _problem_text(files))
        .alias("content"),
        F.when(read, F.least(F.col("size"), limit)).alias("preview_bytes"),
        F.when(read & (F.col("size") > limit), F.lit(True)).alias("truncated"),
        F.when(size_wanted, F.col("size")).alias("size"),
        F.when(read, times.iso_micros(F.col("created_us"), options.timezone)).alias("created"),
        F.when(read, times.iso_micros(F.col("mtime_us"), options.timezone)).alias("modified"),
        F.when(read, times.permissions(F.col("mode"))).alias("permissions"),
        F.when(read, F.lit(options.timezone)).alias("timezone"),
        digest.alias("hash"),
        F.when(failed, F.substring_index(problem, ": ", 1)).alias("exception_type"),
        F.when(failed, F.regexp_replace(problem, "(?s)^[^:]*: ", "")).alias("exception_message"),
        *keep,
    )
