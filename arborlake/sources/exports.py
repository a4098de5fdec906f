"""Reading exports back, and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.functions.jsontext import is_object, strict_json
from arborlake.session import materialise


def _kind(value: Column, field: str) -> Column:
    return F.schema_of_variant(F.variant_get(value, field, "variant"))


def flatten_structure(documents: DataFrame, structure: str = "structure") -> DataFrame:
    """Nested trees (VARIANT, one per row) as ``path, info`` rows, with the other columns kept.

    A node is a file when its ``type`` is a text; a directory that holds something called
    ``type`` or ``size`` stays a directory. One pass per depth, each written out once.
    """
    kept = [c for c in documents.columns if c != structure]
    level = documents.select(*kept, F.lit("").alias("_prefix"), F.col(structure).alias("_node"))
    found = None
    depth = 0
    while True:
        spark = documents.sparkSession
        members = level.lateralJoin(spark.tvf.variant_explode(F.col("_node").outer())).select(
            *kept, "_prefix", F.col("key").alias("_key"), F.col("value").alias("_value"))
        path = F.concat_ws("/", F.nullif("_prefix", F.lit("")), F.col("_key"))
        judged = members.select(
            *kept, path.alias("path"), F.col("_value").alias("info"),
            (is_object(F.col("_value"))
             & ~F.coalesce(_kind(F.col("_value"), "$.type") == "STRING", F.lit(False))
             ).alias("_is_dir"))
        stored = materialise(
            judged.withColumn("info", F.to_json("info")), f"flatten-{depth}"
        ).withColumn("info", F.parse_json("info"))
        leaves = stored.filter("NOT _is_dir").drop("_is_dir")
        found = leaves if found is None else found.unionByName(leaves)
        inner = stored.filter("_is_dir")
        if inner.isEmpty():
            return found
        level = inner.select(*kept, F.col("path").alias("_prefix"), F.col("info").alias("_node"))
        depth += 1


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Exported documents of a folder, one row each: ``structure`` and ``summary``.

    Give it folders that hold one document per file; a document is one row, as a JSON reader
    needs it whole. Use JSON Lines or Parquet exports for large results.
    """
    text = spark.read.text(path, wholetext=True)
    doc = F.parse_json("value")
    return text.select(
        F.variant_get(doc, "$.structure", "variant").alias("structure"),
        F.variant_get(doc, "$.summary", "variant").alias("summary"))


def record_fault(line: Column) -> Column:
    """What keeps a line from being a record of an export, null for a good one.

    A record is a JSON object or array with something in it; so is each item of an array.
    """
    def holds_nothing(value: Column) -> Column:
        return F.to_json(value).isin("{}", "[]")

    def is_scalar(value: Column) -> Column:
        return ~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")

    value = strict_json(line)
    items = F.try_variant_get(value, "$", "array<variant>")
    return (
        F.when(value.isNull(), "no JSON")
        .when(is_scalar(value), "a bare value")
        .when(holds_nothing(value), "no content")
        .when(F.exists(items, is_scalar), "a bare value in a list")
        .when(F.exists(items, holds_nothing), "no content in a list"))


def validate_export(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``is_valid, records, reason`` with the first fault of a JSON Lines export.

    Records are judged in parallel; a fault is placed by its file block and its number there, and
    the records of the blocks before are counted to give the index.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    judged = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        record_fault(F.col("value")).alias("fault"))
    per_block = judged.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("place").alias("start"),
        F.min(F.when(F.col("fault").isNotNull(), F.struct("place", "fault"))).alias("first"))
    blocks = materialise(per_block, "validated")
    place = F.struct("file", "block")
    bad = blocks.filter(F.col("first").isNotNull()).agg(
        F.min(F.struct(place.alias("at"), "start", "first")).alias("bad")).first()["bad"]
    total = blocks.agg(F.sum("n")).first()[0] or 0
    reason = None
    if total == 0:
        reason = "no records"
    elif bad is not None:
        file, block = bad["at"]
        earlier = (F.col("file") < file) | ((F.col("file") == file) & (F.col("block") < block))
        before = blocks.filter(earlier).agg(F.sum("n")).first()[0] or 0
        index = before + bad["first"]["place"] - bad["start"]
        reason = f"record {index}: {bad['first']['fault']}"
    return spark.createDataFrame(
        [(reason is None, total, reason)], "is_valid BOOLEAN, records BIGINT, reason STRING")
