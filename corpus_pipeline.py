"""Corpus pipeline: documents in, encoded documents out, one operator a stage.

Filters decide by row. A row whose identifier is null or repeated is judged by its own text, and the
other rows of that identifier by theirs; of rows that repeat identifier and text one goes on. In groups
of equal or near texts the row that stays is the operator's choice by identifier, where rows of null
or repeated identifiers count as the last ones. A null text counts as empty: such rows are one group of
equal texts, never near copies, and hold no benchmark item. Labels of repeated identifiers are not used.
Extra columns are kept by all stages; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.bpe import recode
from arborlake.llm.decontaminate import decontaminate
from arborlake.llm.exact_dedup import exact_dedup
from arborlake.llm.near_dedup import near_dedup
from arborlake.llm.quality import quality_scores
from arborlake.llm.queries import tokenizer_path
from arborlake.llm.tables import documents, table, with_row_ids
from arborlake.session import delete_folder, new_work_path, scratch

ROW = "_pipeline_row"


def _without(docs: DataFrame, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` but for the rows that ``dropped`` names; it gets them with a number each as ``doc_id``."""
    rows = with_row_ids(docs, ROW)
    out = dropped(rows.withColumn("doc_id", F.col(ROW)).drop(ROW)).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(out, ROW, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels")
    return _without(docs, lambda rows: quality_scores(rows, labels).filter("predicted = 0"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, lambda rows: exact_dedup(rows).filter("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _without(docs, lambda rows: near_dedup(rows).filter("NOT kept"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda rows: decontaminate(rows, items))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether decoding gives the text back."""
    coded = recode(docs, tokenizer_path("byte_bpe_50k.json"))
    return coded.withColumn("round_trip", F.col("decoded").eqNullSafe(
        F.coalesce("text", F.lit("")))).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", encoded),
]

# the classifier and the tokenizer have no SQL form; tests/llm compares with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote is deleted once the next one has read it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_work_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
