"""Record lines: JSON objects with a parent, a name and an info object; issue lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.functions.jsontext import is_object, strict_json
from arborlake.schema import ISSUES


def split_records(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Usable records and rejected lines.

    Usable: an object whose ``info`` (or ``summary``, for a summary record) is an object. The
    rejected lines are returned too, so that nothing is lost silently.
    """
    record = strict_json(F.col(column))
    parsed = lines.withColumn("_record", record)
    body = F.coalesce(
        F.try_variant_get("_record", "$.summary", "variant"),
        F.try_variant_get("_record", "$.info", "variant"),
    )
    has_body = body.isNull() | is_object(body)
    usable = F.coalesce(is_object(F.col("_record")) & has_body, F.lit(False))
    judged = parsed.withColumn("_usable", usable)
    good = judged.filter("_usable").select(
        *lines.columns,
        F.try_variant_get("_record", "$.parent", "string").alias("parent"),
        F.try_variant_get("_record", "$.filename", "string").alias("filename"),
        F.try_variant_get("_record", "$.info", "variant").alias("info"),
        F.try_variant_get("_record", "$.summary", "variant").alias("summary"),
    )
    return good, judged.filter("NOT _usable").select(*lines.columns)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_records(spark.read.text(path))


def parse_issues(lines: DataFrame, column: str = "value") -> DataFrame:
    """Issues from JSON objects, one per line; lines that are no objects are left out."""
    issue = F.from_json(column, ISSUES, {"mode": "PERMISSIVE"})
    return lines.filter(is_object(strict_json(F.col(column)))).select(issue.alias("i")).select("i.*")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """A dump of issue objects, one per line."""
    return parse_issues(spark.read.text(path))


def read_issue_arrays(spark: SparkSession, path: str) -> DataFrame:
    """A dump of issues with one JSON array (or object) per file."""
    return spark.read.schema(ISSUES).option("multiLine", True).json(path)
