"""Tables and helpers that the queries of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arborlake.operators.ordering import numbered
from arborlake.session import materialise

#: rows of an Arrow batch: texts are long, so few of them
ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only; ``lower`` does the same, faster, where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches that stay small however long the texts are."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df.mapInArrow(function, schema)


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """Add a number of each row: its ``doc_id`` where that is unique, else a number no ``doc_id`` has.

    Rows that repeat identifier and text count as one row, and one of them stays; a null text is an
    empty one. Only rows whose identifier is null or repeated are numbered, in the order of
    identifier and text hash.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    repeated = materialise(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(
        "n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "repeated-ids")
    if repeated.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    keys = docs.select("doc_id", sha.alias("_sha")).join(repeated, same, "left_semi").distinct()
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    up = high is None or high < 1 << 62  # beyond all identifiers, on the side that has room
    number = F.col("_number") + (high or 0) if up else F.lit(low) - F.col("_number")
    numbers = numbered(keys, ["doc_id", "_sha"], name="_number").select(
        F.col("doc_id").alias("_id"), F.col("_sha").alias("_text"), number.cast("long").alias(name))
    many = docs.withColumn("_sha", sha).join(
        numbers, same & (F.col("_sha") == F.col("_text"))).drop("_id", "_sha", "_text")
    one = Window.partitionBy(name).orderBy(F.lit(1))
    many = many.withColumn("_copy", F.row_number().over(one)).filter("_copy = 1").drop("_copy")
    plain = docs.join(repeated, same, "left_anti").withColumn(name, F.col("doc_id").cast("long"))
    return materialise(plain.unionByName(many), "numbered-rows")
