"""The file-tree source on a temporary tree, and content loading."""

import os
import time

import pytest
from pyspark.sql import functions as F

from arborlake.operators import analysis, summary
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse
from arborlake.sources import content, filetree

OPTIONS = ScanOptions(excluded_folders=("node_modules", ".git"), exclude_patterns=("*.pyc", "tmp*"),
                      excluded_files=("skip.me",))


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "pkg/__init__.py": b"", ".env": b"A=1", ".git/config": b"[core]", "node_modules/i.js": b"x",
        "pkg/sub/l1.txt": "Schöne Grüße, naïve Übung ".encode("latin-1") * 10,
        "pkg/a.png": bytes.fromhex("89504E470D0A1A0A"), "pkg/mod.py": b"print('x')\n",
        "pkg/mod.pyc": b"\x00", "tmp1/x.txt": b"no", "skip.me": b"", "pkg/big.txt": b"y" * 5000,
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (tmp_path / "pkg" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "link.py").symlink_to(tmp_path / "pkg" / "mod.py")
    return tmp_path


EXPECTED = {"pkg/__init__.py", ".env", "pkg/sub/l1.txt", "pkg/a.png", "pkg/mod.py", "pkg/mod.pyc",
            "skip.me", "pkg/big.txt", "link.py"}


@pytest.mark.parametrize("extra", [{}, {"partitions": 1}, {"partitions": 2, "splits": 3}])
def test_scan_lists_hidden_files_and_prunes(spark, tree, extra):
    rows = filetree.scan(spark, str(tree), OPTIONS, **extra).collect()
    assert sorted(r["path"] for r in rows) == sorted(EXPECTED)
    mod = next(r for r in rows if r["path"] == "pkg/mod.py")
    stat = os.stat(tree / "pkg" / "mod.py")
    assert (mod["size"], mod["mtime_us"], mod["mode"]) == (
        stat.st_size, stat.st_mtime_ns // 1000, stat.st_mode)


@pytest.mark.parametrize("partitions", [1, 4])
def test_followed_links_end_and_count_once(spark, tree, partitions):
    options = ScanOptions(excluded_folders=("node_modules", ".git"),
                          exclude_patterns=("*.pyc", "tmp*"), follow_symlinks=True)
    (tree / "pkg" / "also").symlink_to(tree / "pkg" / "sub", target_is_directory=True)
    paths = [r["path"] for r in
             filetree.scan(spark, str(tree), options, partitions=partitions).collect()]
    names = [p.rsplit("/", 1)[-1] for p in paths]
    assert names.count("l1.txt") == 1 and names.count("mod.py") == 1 and len(paths) == len(EXPECTED)


@pytest.mark.parametrize("follow", [False, True])
def test_level_scan_equals_scan(spark, tree, follow):
    options = ScanOptions(excluded_folders=("node_modules", ".git"), excluded_files=(),
                          exclude_patterns=("*.pyc", "tmp*"), follow_symlinks=follow)
    (tree / "pkg" / "also").symlink_to(tree / "pkg" / "sub", target_is_directory=True)
    columns = ["path", "parent", "filename", "size", "mtime_us", "mode", "location", "real_dir"]
    levels = filetree.scan_levels(spark, str(tree), options, partitions=3).select(*columns)
    found = {r["filename"]: r for r in levels.collect()}
    assert levels.count() == len(found) == len(EXPECTED)
    want = {r["filename"]: r for r in
            filetree.scan(spark, str(tree), options).select(*columns).collect()}
    same = columns if not follow else ["filename", "size", "mtime_us", "mode", "real_dir"]
    for name, row in found.items():
        assert [row[c] for c in same] == [want[name][c] for c in same]


def run(spark, tree, options):
    files = filetree.scan(spark, str(tree), options)
    return analyse(content.with_content(files, options), options)


def test_analysis_of_a_tree(spark, tree):
    options = ScanOptions(excluded_folders=OPTIONS.excluded_folders, max_file_size=4000,
                          exclude_patterns=OPTIONS.exclude_patterns,
                          excluded_files=OPTIONS.excluded_files)
    result = run(spark, tree, options)
    rows = {r["path"]: r for r in result.entries.collect()}
    assert set(rows) == EXPECTED - {"skip.me", "pkg/mod.pyc"}
    assert (rows["pkg/big.txt"]["reason"], rows["pkg/big.txt"]["size"]) == ("file_size", 5000)
    assert rows["pkg/a.png"]["reason"] == "binary_or_image"
    assert rows["pkg/sub/l1.txt"]["content"].startswith("Schöne Grüße")
    assert rows["pkg/mod.py"]["content"] == "print('x')\n"
    assert rows["pkg/mod.py"]["permissions"] == oct(os.stat(tree / "pkg/mod.py").st_mode)
    assert len(rows["pkg/mod.py"]["hash"]) == 16
    totals = result.summary().first()
    assert (totals["total_files"], totals["excluded_files"], totals["included_files"]) == (9, 2, 7)
    assert totals["hash_algorithm"] == "xxhash"


def test_binary_preview_is_cut_but_hash_is_not(spark, tree):
    options = ScanOptions(include_binary=True, binary_preview_bytes=4, text_preview_bytes=5,
                          excluded_folders=OPTIONS.excluded_folders, exclude_patterns=())
    rows = {r["path"]: r for r in run(spark, tree, options).entries.collect()}
    png = rows["pkg/a.png"]
    assert (png["type"], png["content"], png["preview_bytes"], png["truncated"]) == (
        "binary", "iVBORw==", 5 - 1, True)
    import xxhash
    assert png["hash"] == xxhash.xxh64((tree / "pkg/a.png").read_bytes()).hexdigest()
    assert rows["pkg/mod.py"]["content"] == "print" and rows["pkg/mod.py"]["truncated"]


def test_read_failures_become_error_rows(spark, tree):
    options = ScanOptions(excluded_folders=OPTIONS.excluded_folders, exclude_patterns=("tmp*",))
    listed = filetree.scan(spark, str(tree), options).filter("path in ('.env', 'pkg/mod.py')")
    moved = listed.withColumn("location", F.when(F.col("path") == ".env", F.lit("/nowhere/.env"))
                              .otherwise(F.col("location")))
    result = analyse(content.with_content(moved, options), options)
    rows = {r["path"]: r for r in result.entries.collect()}
    assert rows[".env"]["type"] == "error"
    assert rows[".env"]["exception_type"] == "FileNotFoundError"
    assert rows[".env"]["content"].startswith("OS error: [Errno 2]")
    assert result.summary().first()["failed_files"] == 1
    assert [r["file"] for r in result.failures().collect()] == [".env"]
    broken = listed.withColumn("stat_error", F.lit("PermissionError: denied"))
    row = analysis.entries(content.with_content(broken, options), options).first()
    assert row["content"] == "Failed to get file stats: denied"
    assert summary.counters(analysis.traversed(listed, options)).first()["included"] == 2


def test_content_is_streamed_in_small_batches(spark, tree, monkeypatch):
    monkeypatch.setattr(content, "BATCH_BYTES", 1)
    files = filetree.scan(spark, str(tree), OPTIONS)
    rows = content.with_content(files, OPTIONS).collect()
    assert {r["path"]: len(r["content"]) for r in rows}["pkg/big.txt"] == 5000 and len(rows) == 9


def test_binary_file_adapter(spark, tree):
    plain = tree / "pkg" / "sub"
    rows = content.files_of_binary(
        spark.read.format("binaryFile").load(str(plain)), f"file:{plain}").collect()
    assert [(r["path"], r["parent"], r["filename"]) for r in rows] == [("l1.txt", "", "l1.txt")]


def test_stream_sees_new_files_once(spark, tree, tmp_path):
    from arborlake.session import new_work_path
    work = new_work_path(spark, "test-tree-stream")
    stream = filetree.scan_stream(spark, str(tree), OPTIONS, settleSeconds="0.1")

    def once():
        time.sleep(0.3)
        query = stream.writeStream.format("parquet").trigger(availableNow=True).option(
            "checkpointLocation", f"{work}/cp").start(f"{work}/out")
        assert query.awaitTermination(60)
        return sorted(r["path"] for r in spark.read.parquet(f"{work}/out").collect())

    first = once()
    assert first == sorted(EXPECTED)
    (tree / "pkg" / "new.py").write_text("new")
    assert once() == sorted([*EXPECTED, "pkg/new.py"])


@pytest.mark.parametrize("splits", [1, 2])
def test_wide_root_gives_few_tasks(spark, tmp_path, splits):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.txt").write_text(str(i))
    options = ScanOptions(excluded_folders=())
    files = filetree.scan(spark, str(tmp_path), options, partitions=4, splits=splits)
    assert files.rdd.getNumPartitions() <= 4
    assert files.count() == 300 and files.select("path").distinct().count() == 300
