"""Whole runs over a temporary tree, recorded and compared."""

import glob
import json

import pytest

from arborlake.operators import runs
from arborlake.options import ScanOptions
from arborlake.plans.tree_run import cache_table, history_table, run_tree
from arborlake.schema import RUN_SUMMARY_FIELDS
from arborlake.session import new_work_path
from arborlake.sinks.runs import run_json
from arborlake.sources import content


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {"src/a.py": "a", "src/b.py": "b", "README.md": "r", "x.pyc": "x",
                       "dist/no.js": "n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_two_runs_with_state_and_history(spark, tree, tmp_path, monkeypatch):
    work = new_work_path(spark, "test-run")
    state, history = cache_table(spark, f"{work}/cache", buckets=4), history_table(spark, f"{work}/runs")
    first = run_tree(spark, str(tree), str(tmp_path / "one"), "json", state=state, history=history)
    document = json.loads("".join(
        open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/one/part-*"))))
    assert set(document["structure"]) == {"src", "README.md"}
    assert document["summary"]["total_files"] == 4 and document["summary"]["excluded_files"] == 1
    (tree / "src" / "b.py").write_text("changed")
    (tree / "src" / "c.py").write_text("c")
    (tree / "README.md").unlink()
    opened = []
    original = content.with_content
    monkeypatch.setattr(content, "with_content", lambda files, options: opened.extend(
        r["path"] for r in files.select("path").collect()) or original(files, options))
    second = run_tree(spark, str(tree), str(tmp_path / "two"), "jsonl", state=state,
                      history=history, preset="fast")
    assert sorted(opened) == ["src/b.py", "src/c.py"]
    diff = runs.diff_results(first.entries, second.entries, ("type", "content"))
    assert {(r["path"], r["status"]) for r in diff.collect()} == {
        ("README.md", "removed"), ("src/a.py", "same"), ("src/b.py", "changed"),
        ("src/c.py", "added")}
    recorded = history.read()
    pairs = spark.createDataFrame(
        [(first.identifier, second.identifier)], "left_id STRING, right_id STRING")
    compared = {r["metric"]: (r["left"], r["right"]) for r in
                runs.compare_metrics(recorded, pairs, RUN_SUMMARY_FIELDS).collect()}
    assert compared["Output Format"] == ("json", "jsonl")
    assert compared["Preset"] == ("default", "fast")
    assert compared["Summary: total_files"] == ("4", "4")
    assert runs.search(recorded, "FAST").count() == 1
    assert state.read().count() == 4
    export = {r["identifier"]: json.loads(r["document"]) for r in run_json(
        recorded, documents=("configuration",), pretty=True).collect()}[second.identifier]
    assert export["configuration"]["max_file_size"] == 50 * 1024 * 1024
    assert list(export) == sorted(export) and export["preset"] == "fast"
    assert list(export["configuration"]) == sorted(export["configuration"])


def test_upkeep_is_part_of_a_run(spark, tree, tmp_path):
    state = cache_table(spark, new_work_path(spark, "test-upkeep"), buckets=4)
    run_tree(spark, str(tree), str(tmp_path / "one"), "jsonl", state=state)
    (tree / "README.md").unlink()
    run_tree(spark, str(tree), str(tmp_path / "two"), "jsonl", state=state, drop_orphans=True)
    assert {r["path"].rsplit("/", 1)[1] for r in state.read().collect()} == {"a.py", "b.py"}
    run_tree(spark, str(tree), str(tmp_path / "three"), "jsonl", state=state, upkeep={"limit_bytes": 1})
    assert state.read().count() == 0


def test_run_without_summary(spark, tree, tmp_path):
    result = run_tree(spark, str(tree), str(tmp_path / "out"), "parquet",
                      ScanOptions(encoding="utf-8"), include_summary=False, by_levels=True)
    assert result.summary.first()["included_files"] == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_two_roots_share_a_state_table(spark, tmp_path):
    import os
    for name in ("r1", "r2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "README.md").write_text(name)
        os.utime(tmp_path / name / "README.md", (1_700_000_000, 1_700_000_000))
    state = cache_table(spark, new_work_path(spark, "test-roots"), buckets=4)
    for _ in range(2):
        for name in ("r1", "r2"):
            run = run_tree(spark, str(tmp_path / name), new_work_path(spark, "test-out"), "jsonl", state=state)
            assert [r["content"] for r in run.entries.collect()] == [name]
    assert state.read().count() == 2


def test_incremental_runs_keep_files_whose_stat_failed(spark, files):
    from pyspark.sql import functions as F
    from arborlake.plans.analysis import analyse, analyse_incremental
    from arborlake.schema import CACHE
    listed = files({"a.txt": b"a", "b.txt": b"b"}).withColumn(
        "stat_error", F.when(F.col("path") == "b.txt", "denied")).withColumn(
        "size", F.when(F.col("path") == "a.txt", F.col("size")))
    full = {(r["path"], r["type"]) for r in analyse(listed, ScanOptions()).entries.collect()}
    part = analyse_incremental(
        listed.drop("content"), spark.createDataFrame([], CACHE), ScanOptions(),
        lambda rows: rows.join(listed.select("path", "content"), "path")).entries
    assert {(r["path"], r["type"]) for r in part.collect()} == full == {("a.txt", "text"), ("b.txt", "error")}
