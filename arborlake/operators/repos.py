"""Repository records and issue lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborlake.functions.paths import is_repo_url, repo_name, repo_owner
from arborlake.operators.filters import outside_git


def rollup(files: DataFrame, key: str = "repo") -> DataFrame:
    """Size and latest mtime per repository, git's own files left out."""
    return files.filter(outside_git(F.col("path"))).groupBy(key).agg(
        F.sum("size").alias("total_size"), F.max("mtime_us").alias("latest_mtime_us")
    )


def parsed_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    url = F.col(column)
    return urls.withColumns(
        {"is_valid": is_repo_url(url), "owner": repo_owner(url), "repo": repo_name(url)}
    )


def open_issues(issues: DataFrame) -> DataFrame:
    """Issues proper: objects without a ``pull_request`` key, titled ``#n - title``."""
    return issues.filter(F.col("pull_request").isNull()).withColumn(
        "caption", F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" - "), F.col("title"))
    )
