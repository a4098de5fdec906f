"""Physical plans: pushdown, pruning, and nothing gathered."""

import re

import pytest
from pyspark.sql import functions as F

from arborlake.operators import cache, filters, ordering, summary, tree
from arborlake.operators.analysis import entries, traversed
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse
from arborlake.plans.catalog import QUERIES
from arborlake.session import new_work_path

SF = "/root/testdata/sf0.001"
OPTIONS = ScanOptions(detect_charset=False, hash_algorithm="md5", encoding="utf-8")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """A files table as it lies on disk."""
    from arborlake.plans import views
    path = new_work_path(spark, "test-files")
    views.files(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def read_schema(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)[0]


def test_simple_globs_reach_the_scan(stored):
    options = ScanOptions(excluded_files=(), exclude_patterns=("*.pyc",))
    kept = stored.filter(~filters.name_excluded(F.col("filename"), options)).select("path")
    plan = plan_of(kept)
    assert "StringEndsWith(filename,.pyc)" in plan and "content" not in read_schema(plan)


def test_size_rule_reaches_the_scan(stored):
    small = stored.filter(F.col("size") <= OPTIONS.max_file_size).select("path")
    assert "LessThanOrEqual(size,52428800)" in plan_of(small)


def test_counters_and_tree_read_names_only(stored):
    for df in (summary.counters(traversed(stored, OPTIONS)), tree.directories(stored),
               analyse(stored, OPTIONS).summary()):
        assert "content" not in read_schema(plan_of(df)) and "text" not in read_schema(plan_of(df))


def test_probe_reads_no_content(spark, stored):
    state = spark.createDataFrame([], "path STRING, file_hash STRING, file_info STRING, "
                                      "size BIGINT, mtime_us BIGINT")
    probed = cache.misses(stored, state).select("path")
    assert "content" not in read_schema(plan_of(probed))


def test_jvm_options_leave_no_python_stage(stored):
    plan = plan_of(entries(traversed(stored, OPTIONS), OPTIONS))
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan


def test_ordered_operators_shuffle_counts_only(spark, stored):
    plan = plan_of(ordering.numbered(stored.select("path", "lang"), ["path"], ["lang"]))
    window = plan[plan.index("Window ["):]
    assert "_n" in window and "path" not in window.split("FileScan")[0]


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("stream_")])
def test_no_cross_joins_and_no_gathering(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for match in re.finditer(r"Exchange SinglePartition[^\n]*\n([^\n]*)", plan):
        below = match.group(1)
        allowed = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "Sort")
        assert any(a in below for a in allowed), below


def test_catalogue_run_has_no_python_stage(spark):
    plan = plan_of(QUERIES["analyse_files"](spark, SF))
    assert "Python" not in plan and "Exchange" not in plan
