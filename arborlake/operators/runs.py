"""Run history: filters, comparison, differences and reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.functions.display import fixed
from arborlake.functions.times import run_time

METADATA = (
    "Display Name", "Repository", "Preset", "Output Format", "Timestamp", "Duration (s)", "Files",
)


def _contains(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.strip().lower()))


def preset_text() -> Column:
    return F.coalesce(F.nullif("preset", F.lit("")), F.lit("default"))


def search(runs: DataFrame, text: str) -> DataFrame:
    """Runs whose name, repository, preset and format together hold the text, in any case."""
    haystack = F.concat_ws(" ", "display_name", "repository", preset_text(), "output_format")
    return runs.filter(_contains(haystack, text)) if text.strip() else runs


def of_repository(runs: DataFrame, text: str) -> DataFrame:
    return runs.filter(_contains(F.coalesce("repository", F.lit("")), text)) if text.strip() else runs


def of_preset(runs: DataFrame, text: str) -> DataFrame:
    return runs.filter(_contains(F.coalesce("preset", F.lit("")), text)) if text.strip() else runs


def display_rows(runs: DataFrame) -> DataFrame:
    """The history table as shown: text columns, ``-`` for what is not known."""
    return runs.select(
        "identifier",
        F.col("display_name").alias("name"),
        run_time(F.col("ts")).alias("time"),
        "repository",
        preset_text().alias("preset"),
        "output_format",
        F.coalesce(F.concat(fixed(F.col("duration_seconds"), 2), F.lit("s")), F.lit("-"))
        .alias("duration"),
        F.coalesce(F.col("processed_files").cast("string"), F.lit("-")).alias("files"),
    )


def sort_key(column: str) -> Column:
    """Case-insensitive text order, as the history table sorts any of its columns."""
    return F.lower(F.col(column).cast("string"))


def sorted_by(runs: DataFrame, column: str, *, descending: bool = False) -> DataFrame:
    key = sort_key(column)
    return runs.orderBy(key.desc() if descending else key.asc(), "identifier")


def filter_values(runs: DataFrame, column: str) -> DataFrame:
    """Distinct values for a filter menu, in order."""
    return runs.select(column).distinct().orderBy(column)


def _metadata_cells() -> list[tuple[str, Column]]:
    return list(zip(METADATA, (
        F.col("display_name"),
        F.col("repository"),
        preset_text(),
        F.col("output_format"),
        run_time(F.col("ts")),
        fixed(F.col("duration_seconds"), 2),
        F.col("processed_files").cast("string"),
    )))


def metric_rows(runs: DataFrame, summary_columns: tuple[str, ...] = ()) -> DataFrame:
    """Runs unpivoted to ``identifier, section, position, metric, value`` without missing values.

    Section 0 is the metadata, section 1 the summary. Names in order give positions, so a
    report needs no second look at the keys.
    """
    cells = [
        F.struct(F.lit(0).alias("section"), F.lit(i).alias("position"), F.lit(name).alias("metric"),
                 value.alias("value"))
        for i, (name, value) in enumerate(_metadata_cells())
    ] + [
        F.struct(F.lit(1).alias("section"), F.lit(i).alias("position"), F.lit(name).alias("metric"),
                 F.col(name).cast("string").alias("value"))
        for i, name in enumerate(sorted(summary_columns))
    ]
    return runs.select("identifier", F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def _cells(summary_columns: tuple[str, ...]) -> list[tuple[str, Column]]:
    """Comparison metrics of a run row, in order: metadata, then the summary by name."""
    return _metadata_cells() + [
        (f"Summary: {name}", F.col(name).cast("string")) for name in sorted(summary_columns)
    ]


def compare_metrics(
    runs: DataFrame, pairs: DataFrame, summary_columns: tuple[str, ...] = ()
) -> DataFrame:
    """Both values of every metric for pairs ``left_id, right_id``; '' where one side has none.

    The runs are joined to the pairs as rows and unpivoted side by side afterwards, so metrics
    are neither shuffled nor grouped.
    """
    names = [name for name, _ in _cells(summary_columns)]

    def side(key: str, prefix: str) -> DataFrame:
        values = [v.alias(f"{prefix}{i}") for i, (_, v) in enumerate(_cells(summary_columns))]
        return runs.select(F.col("identifier").alias(key), *values)

    joined = pairs.join(side("left_id", "_l"), "left_id").join(side("right_id", "_r"), "right_id")
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("metric"),
            F.coalesce(f"_l{i}", F.lit("")).alias("left"),
            F.coalesce(f"_r{i}", F.lit("")).alias("right"),
            F.coalesce(f"_l{i}", f"_r{i}").isNotNull().alias("_known"),
        )
        for i, name in enumerate(names)
    ])
    return joined.select("left_id", "right_id", F.inline(cells)).filter("_known").drop("_known")


def metric_names(runs: DataFrame, summary_columns: tuple[str, ...] = ()) -> DataFrame:
    """Union of the metric names two runs or run sets use, in order."""
    return metric_rows(runs, summary_columns).select("metric").distinct().orderBy("metric")


def diff_results(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per path: added, removed, same, or one changed row per differing column.

    A full outer join on the unique path with null-safe comparison.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        values = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
        return df.select("path", values.alias(name))

    joined = side(left, "old").join(side(right, "new"), "path", "full_outer")
    changes = F.filter(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"old.{c}").alias("old_value"),
                     F.col(f"new.{c}").alias("new_value"))
            for c in columns
        ]),
        lambda cell: ~cell["old_value"].eqNullSafe(cell["new_value"]),
    )
    nothing = F.array(F.struct(*[F.lit(None).cast("string").alias(n)
                                 for n in ("column", "old_value", "new_value")]))
    status = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.size(changes) == 0, F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    cells = F.when(status == "changed", changes).otherwise(nothing)
    return joined.select("path", status.alias("status"), F.inline(cells))


def differ(diff: DataFrame) -> bool:
    """True when a diff holds any difference; stops at the first one."""
    return not diff.filter(F.col("status") != "same").isEmpty()


def report_lines(runs: DataFrame, summary_columns: tuple[str, ...] = ()) -> DataFrame:
    """Report of each run as ``identifier, section, position, line``.

    Overview first; with a summary, a blank line, a title and the metrics by name.
    """
    rows = metric_rows(runs, summary_columns)
    lines = rows.select(
        "identifier",
        F.when(F.col("section") == 0, F.lit(0)).otherwise(F.lit(2)).alias("section"),
        "position",
        F.when(F.col("section") == 0, F.concat_ws(": ", "metric", "value"))
        .otherwise(F.concat(F.lit("- "), F.concat_ws(": ", "metric", "value")))
        .alias("line"),
    )
    if not summary_columns:
        return lines
    any_metric = functools.reduce(
        lambda a, b: a | b, [F.col(c).isNotNull() for c in summary_columns]
    )
    titles = runs.filter(any_metric).select(
        "identifier",
        F.inline(F.array(
            F.struct(F.lit(1).alias("section"), F.lit(0).alias("position"), F.lit("").alias("line")),
            F.struct(F.lit(1).alias("section"), F.lit(1).alias("position"),
                     F.lit("Summary metrics:").alias("line")),
        )),
    )
    return lines.unionByName(titles)


def report_text(runs: DataFrame, summary_columns: tuple[str, ...] = ()) -> DataFrame:
    """The whole report of each run as one text, made from its row without any grouping."""
    def lines(cells: list[tuple[str, Column]], start: str) -> list[Column]:
        return [
            F.when(value.isNotNull(), F.concat(F.lit(f"{start}{name}: "), value))
            for name, value in cells
        ]

    overview = lines(_metadata_cells(), "")
    metrics = [(name, F.col(name).cast("string")) for name in sorted(summary_columns)]
    known = F.coalesce(*[value for _, value in metrics], F.lit(None)).isNotNull()
    title = F.when(known, F.lit("\nSummary metrics:"))
    return runs.select(
        "identifier", F.concat_ws("\n", *overview, title, *lines(metrics, "- ")).alias("report"))
