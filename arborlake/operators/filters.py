"""Exclusion rules on a table of files, and the record filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import patterns
from arborlake.functions.paths import suffix
from arborlake.options import ScanOptions


# fixed values: the sentences of the filter preview
FOLDER_REASON = "Matches excluded folder '{}'."
NAME_REASON = "Matches excluded filename '{}'."
REGEX_REASON = "Matches regex pattern '{}'."
GLOB_REASON = "Matches glob pattern '{}'."
IMAGE_REASON = "Tagged as image asset via extension '{}'."
KEPT_REASON = "No exclusion matched. This path will be analysed."


def _sentence(form: str, value: Column) -> Column:
    return F.replace(F.lit(form), F.lit("{}"), value)


def in_excluded_folder(parent: Column, folders: Sequence[str]) -> Column:
    """True when any directory above the file has one of the names (exact, case-sensitive)."""
    if not folders:
        return F.lit(False)
    return F.arrays_overlap(F.split(parent, "/"), F.array(*[F.lit(f) for f in folders]))


def in_matching_folder(parent: Column, rules: Sequence[str]) -> Column:
    """The name rules applied to every directory above the file."""
    if not rules:
        return F.lit(False)
    return F.exists(
        F.split(parent, "/"), lambda name: (name != "") & patterns.matches_any(name, rules)
    )


def has_excluded_name(filename: Column, names: Sequence[str]) -> Column:
    return filename.isin(*names) if names else F.lit(False)


def reachable(parent: Column, options: ScanOptions) -> Column:
    """True for files a walk would come to: no excluded directory above them."""
    return ~(
        in_excluded_folder(parent, options.excluded_folders)
        | in_matching_folder(parent, options.exclude_patterns)
    )


def name_excluded(filename: Column, options: ScanOptions) -> Column:
    return has_excluded_name(filename, options.excluded_files) | patterns.matches_any(
        filename, options.exclude_patterns
    )


def without_listed_names(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Anti join with a long name list (column ``filename``).

    No broadcast hint: Spark compares the list's size with its threshold and otherwise
    shuffles both sides; the list is made distinct first, so a repeated name costs nothing.
    """
    return files.join(listed.select("filename").distinct(), "filename", "left_anti")


def preview_reason(path: Column, options: ScanOptions) -> Column:
    """First reason to leave a path out, or the sentence for a path that stays."""
    lowered = F.lower(path)
    name = F.lower(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1))
    parts = F.split(lowered, "/")
    reason = F.when(F.lit(False), F.lit(""))
    for folder in options.excluded_folders:
        if folder:
            folder = folder.lower()
            reason = reason.when(
                F.array_contains(parts, folder), F.lit(FOLDER_REASON.format(folder))
            )
    names = [n.lower() for n in options.excluded_files]
    if names:
        reason = reason.when(
            (name != "") & name.isin(*names),
            _sentence(NAME_REASON, name),
        )
    for rule in options.exclude_patterns:
        if rule.startswith(patterns.REGEX_PREFIX):
            body = rule[len(patterns.REGEX_PREFIX):]
            reason = reason.when(
                patterns.matches_regex(path, body, anchored=False),
                F.lit(REGEX_REASON.format(body)),
            )
        elif rule:
            reason = reason.when(
                patterns.matches_glob(path, rule) | patterns.matches_glob(name, rule),
                F.lit(GLOB_REASON.format(rule)),
            )
    ext = suffix(name)
    images = [e.lower() for e in options.image_extensions]
    if images:
        reason = reason.when(
            (ext != "") & ext.isin(*images),
            _sentence(IMAGE_REASON, ext),
        )
    return reason.otherwise(F.lit(KEPT_REASON))


def filter_preview(files: DataFrame, options: ScanOptions) -> DataFrame:
    reasoned = files.withColumn("reason", preview_reason(F.col("path"), options))
    return reasoned.withColumn("excluded", F.col("reason") != KEPT_REASON)


def estimate_filter(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Files the estimator counts: its globs see the relative path, regex rules are unknown to it."""
    keep = ~(
        in_excluded_folder(F.col("parent"), options.excluded_folders)
        | has_excluded_name(F.col("filename"), options.excluded_files)
    )
    for rule in options.exclude_patterns:
        keep = keep & ~patterns.matches_glob(F.col("path"), rule)
    return files.filter(keep)


def outside_git(path: Column) -> Column:
    return ~F.contains(path, F.lit(".git"))


def drop_empty_fields(record: Column) -> Column:
    """JSON text of a string map without its empty and missing values."""
    return F.to_json(F.map_filter(record, lambda _, v: v.isNotNull() & (v != "")))
