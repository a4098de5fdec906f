"""Queries of the operators, with SQL where DuckDB can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.llm.tables import documents, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.quality import quality_scores
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op2_exact_dedup", f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256({_LOWER}) AS text_sha256,
  min(doc_id) OVER g AS smallest_id
FROM documents WINDOW g AS (PARTITION BY {_LOWER})""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.exact_dedup import exact_dedup
    return exact_dedup(documents(spark, sf_dir))


def _decontamination_sql() -> str:
    from arborlake.llm.decontaminate import ORACLE as sql
    return sql


@query("op3_decontaminate", _decontamination_sql())
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.decontaminate import decontaminate
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.near_dedup import near_dedup
    return near_dedup(documents(spark, sf_dir))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.secrets import listed, secret_scan
    found = secret_scan(documents(spark, sf_dir))

    def of(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.bpe import recode
    path = tokenizer_path("byte_bpe_50k.json")
    return recode(documents(spark, sf_dir).select("doc_id", "text"), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op8_jump_shards")
def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.sharding import shard
    return shard(documents(spark, sf_dir))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.substrings import substring_dedup
    return substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op4_ppm_scores")
def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.ppm import lm_scores
    return lm_scores(documents(spark, sf_dir))


@query("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.token_files import token_checksums, write_token_files
    from arborlake.session import new_work_path
    path = new_work_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), path, end_id=2)
    return token_checksums(spark, path)


def _trie_sql() -> str:
    from arborlake.llm.prefix_trie import ORACLE as sql
    return sql


@query("op12_prefix_trie", _trie_sql())
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt, with_ends_hash
    return with_ends_hash(prefix_trie(rebuilt(ordered_turns(table(spark, sf_dir, "conversations")))))


def _negatives_sql() -> str:
    from arborlake.llm.hard_negatives import ORACLE as sql
    return sql


@query("op13_hard_negatives", _negatives_sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.hard_negatives import hard_negatives, quantised
    rows = quantised(table(spark, sf_dir, "embeddings")).withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
