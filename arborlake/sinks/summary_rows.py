"""A run summary as rows for the text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.operators.tree import LAST

BOOLEAN, NUMBER, TEXT = "boolean", "number", "text"


def fields(summary: DataFrame) -> list[tuple[str, str]]:
    """Summary columns in order with their kind; ``failed_files`` is written from its table."""
    kinds = []
    for field in summary.schema.fields:
        if field.name == "failed_files":
            continue
        simple = field.dataType.simpleString()
        kind = BOOLEAN if simple == "boolean" else TEXT if simple == "string" else NUMBER
        kinds.append((field.name, kind))
    return kinds


def field_rows(summary: DataFrame) -> DataFrame:
    """``position, name, kind, value`` with the value as text; missing values are left out."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("kind"),
                 F.col(name).cast("string").alias("value"))
        for i, (name, kind) in enumerate(fields(summary))
    ])
    return summary.select(F.inline(cells)).filter(F.col("value").isNotNull())


def key(*parts: Column | str) -> Column:
    """Sort key below the end of the structure."""
    return F.array(F.lit(LAST), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def line(sort_key: Column, rank: int | Column, text: Column) -> list[Column]:
    return [
        sort_key.cast("array<string>").alias("key"),
        (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"),
        text.alias("line"),
    ]


def one_line(summary: DataFrame, sort_key: Column, rank: int, text: str) -> DataFrame:
    return summary.select(*line(sort_key, rank, F.lit(text)))


def json_value(kind: Column, value: Column, quoted: Column) -> Column:
    return F.when(kind == TEXT, quoted).otherwise(value)
