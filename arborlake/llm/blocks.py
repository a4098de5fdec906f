"""Blocks of documents: bounded groups that look up corpus-wide facts once for all their texts.

A block has about ``BLOCK_BYTES`` of text. Its tasks ask only for the keys that its own texts
hold, so what travels to a block is bounded by the block, however large the corpus-wide table is,
and a key that every document holds travels once a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.llm.tables import arrow_map

BLOCK_BYTES = 16 << 20


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``doc_id, row, text, block`` and the number of blocks; ``row`` tells apart texts that repeat an identifier.

    The number of blocks is fixed here, by one sum over the table.
    """
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"),
                       text.alias("text"))
    return rows.withColumn("block", block_of(blocks)), blocks


def block_of(blocks: int) -> Column:
    """Block of a row with ``doc_id`` and ``row``."""
    return F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int")


def with_facts(blocks: DataFrame, facts: DataFrame, function, schema: str) -> DataFrame:
    """``function(texts, facts)`` for each block, both as Arrow tables; blocks without facts too."""
    arrow_map(blocks.limit(0), lambda batches: batches, blocks.schema)  # sets small batches
    return blocks.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(function, schema)
