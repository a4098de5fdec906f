"""Run summaries, progress figures and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions import display


# fixed values: the three status sentences
OF_TOTAL = "{} Processed %d of %d files (%d%% complete)"
WITHOUT_TOTAL = "{} Processed %d files before stopping"
NOTHING_DONE = "{} No files were processed"


def counters(rows: DataFrame) -> DataFrame:
    """Walk counters: ``included`` before any size or binary tag, ``excluded`` by name only."""
    return rows.agg(
        F.count_if(~F.col("name_excluded")).alias("included"),
        F.count_if(F.col("name_excluded")).alias("excluded"),
    )


def type_counts(rows: DataFrame) -> DataFrame:
    """Included files per type and reason."""
    return (
        rows.filter(~F.col("name_excluded"))
        .groupBy("type", "reason")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def excluded_percentage(excluded: Column, total: Column) -> Column:
    return F.when(total > 0, excluded / F.greatest(total, F.lit(1)) * 100).otherwise(F.lit(0.0))


def run_summary(
    rows: DataFrame, *, failed: Column | None = None, stopped_early: bool = False,
    hash_algorithm: str | None = None,
) -> DataFrame:
    """One row per run, from rows with ``name_excluded`` and ``type`` (or the test ``failed``).

    The failed files themselves are the table ``failures``: their number grows with the data,
    so they do not go into one cell. ``failed_files`` here is their count.
    """
    failed = F.col("type") == "error" if failed is None else failed
    counted = rows.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("name_excluded")).alias("excluded_files"),
        F.count_if(~F.col("name_excluded") & failed).alias("failed_files"),
    )
    total, excluded = F.col("total_files"), F.col("excluded_files")
    return counted.select(
        "total_files",
        "excluded_files",
        (total - excluded).alias("included_files"),
        excluded_percentage(excluded, total).alias("excluded_percentage"),
        "failed_files",
        F.lit(stopped_early).alias("stopped_early"),
        (total - excluded).alias("processed_files"),
        F.lit(hash_algorithm).alias("hash_algorithm"),
    )


def failures(entries: DataFrame) -> DataFrame:
    """``file, error`` of every error entry."""
    return entries.filter(F.col("type") == "error").select(
        F.col("path").alias("file"),
        F.coalesce("content", F.lit("Unknown error")).alias("error"),
    )


def with_streaming_defaults(
    derived: DataFrame, supplied: DataFrame, estimate: Column, key: str = "run"
) -> DataFrame:
    """Fill what a supplied summary lacks from the counts of the delivered entries.

    ``derived`` has ``run, included_files, failed_files``; ``supplied`` has one nullable
    summary row for some of the runs.
    """
    s = supplied.select(key, *[F.col(c).alias(f"_{c}") for c in supplied.columns if c != key])
    joined = derived.join(s, key, "left")
    included = F.coalesce("_included_files", "included_files")
    total = F.coalesce("_total_files", included)
    return joined.select(
        key,
        included.alias("included_files"),
        F.coalesce("_processed_files", "included_files").alias("processed_files"),
        F.coalesce("_failed_files", "failed_files").alias("failed_files"),
        F.coalesce("_excluded_files", F.lit(0).cast("long")).alias("excluded_files"),
        total.alias("total_files"),
        F.greatest(estimate, total).alias("estimated_total_files"),
    )


def throughput(processed: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """Files per second, files left and the time they should take."""
    rate = F.when(elapsed > 0, processed / elapsed).otherwise(F.lit(0.0))
    left = F.greatest(total - processed, F.lit(0))
    return {
        "files_per_second": rate,
        "remaining_files": left,
        "estimated_remaining": F.when(rate > 0, left / rate),
    }


def progress_percent(current: Column, total: Column) -> Column:
    share = F.least(F.greatest(current / F.greatest(total, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return F.floor(share * 100).cast("long")


def progress_message(prefix: str, current: Column, total: Column) -> Column:
    """One of the three status sentences: with a known total, without one, or nothing done."""
    current = F.greatest(F.coalesce(current, F.lit(0)), F.lit(0))
    total = F.greatest(F.coalesce(total, F.lit(0)), F.lit(0))
    return (
        F.when(
            total > 0,
            F.format_string(
                OF_TOTAL.format(prefix), current, total, progress_percent(current, total),
            ),
        )
        .when(current > 0, F.format_string(WITHOUT_TOTAL.format(prefix), current))
        .otherwise(F.lit(NOTHING_DONE.format(prefix)))
    )


def growing_estimate(estimates: DataFrame, key: str, value: str) -> DataFrame:
    """The estimate of a run only ever grows: its maximum so far."""
    return estimates.groupBy(key).agg(F.max(value).alias("estimated_total_files"))


def buffer_counter(rows: DataFrame, capacity: int) -> DataFrame:
    """Shown rows against the buffer size, and whether it is nearly full (90 %)."""
    return rows.agg(F.least(F.count(F.lit(1)), F.lit(capacity)).alias("shown")).select(
        "shown",
        F.lit(capacity).cast("long").alias("capacity"),
        (F.col("shown") >= F.lit(capacity * 0.9)).alias("nearly_full"),
    )


FAILED_FILE = "Failed file"


def overview(summary: DataFrame, repository: str | None = None,
             failures: DataFrame | None = None) -> DataFrame:
    """Summary rows as display text: ``position, label, text``.

    Below them, a row for each failed file with its error on a second line, at the last position.
    """
    def text(name: str) -> Column:
        return display.thousands(F.col(name))

    rows = [
        ("Repository", F.coalesce(F.lit(repository).cast("string"), F.lit(display.DASH))),
        ("Total files", text("total_files")),
        ("Processed files", F.coalesce(F.nullif(text("processed_files"), F.lit(display.DASH)),
                                       text("included_files"))),
        ("Excluded files", text("excluded_files")),
        ("Excluded", display.percent(F.col("excluded_percentage"))),
        ("Failed files", F.col("failed_files").cast("string")),
        ("Hash algorithm", F.coalesce("hash_algorithm", F.lit(display.DASH))),
        ("Status", F.when(F.col("stopped_early"), F.lit("Stopped early"))
         .otherwise(F.lit("Completed"))),
    ]
    cells = F.array(*[
        F.struct(F.lit(i).cast("long").alias("position"), F.lit(label).alias("label"),
                 value.alias("text"))
        for i, (label, value) in enumerate(rows, start=1)
    ])
    shown = summary.select(F.inline(cells))
    if failures is None:
        return shown
    return shown.unionByName(failures.select(
        F.lit(len(rows) + 1).cast("long").alias("position"), F.lit(FAILED_FILE).alias("label"),
        F.concat(F.coalesce("file", F.lit("Unknown file")), F.lit("\n  "),
                 F.coalesce("error", F.lit("Unknown error"))).alias("text")))
