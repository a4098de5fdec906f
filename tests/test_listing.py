"""Written listings: bounded chunks, windows of change and streams that go on where they were."""

import os

import pytest
from pyspark.sql import functions as F

from arborlake.operators import ordering
from arborlake.options import ScanOptions
from arborlake.session import folders, new_work_path
from arborlake.sources import listing

OPTIONS = ScanOptions(excluded_folders=(), exclude_patterns=(), excluded_files=())


def test_running_sums(spark):
    rows = [(i * 7919 % 1000, i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "k INT, v INT").repartition(9)
    got = {r["k"]: (r["n"], r["s"]) for r in ordering.running_sums(
        df, ["k"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    before = 0
    for i, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (i, before)
        before += v


@pytest.mark.parametrize("max_files, max_bytes", [(7, 10**9), (10**6, 100), (5, 60), (1, 1)])
def test_chunks(spark, max_files, max_bytes):
    rows = [(f"p{i}", None if i == 3 else i % 31, i % 5) for i in range(200)]
    files = spark.createDataFrame(rows, "path STRING, size LONG, mtime_us LONG").repartition(4)
    got = listing.in_chunks(files, max_files, max_bytes).collect()
    chunks = {}
    for r in sorted(got, key=lambda r: (r["mtime_us"], r["path"])):
        chunks.setdefault(r["chunk"], []).append(r)
    assert list(chunks) == list(range(len(chunks))) and len(got) == 200
    for rows in chunks.values():
        assert len(rows) <= max_files and sum(r["size"] or 0 for r in rows[:-1]) < max_bytes
    with pytest.raises(ValueError):
        listing.in_chunks(files, 0)


def _tree(tmp_path, names):
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)


def test_stream_over_a_growing_tree(spark, tmp_path):
    root, work = tmp_path / "tree", new_work_path(spark, "test-listing")
    _tree(root, [f"d{i % 3}/f{i}.txt" for i in range(20)])
    batches = []

    def take(batch, batch_id):
        rows = batch.collect()
        if rows:
            batches.append([r["path"] for r in rows])

    def run():
        batches.clear()
        rows = listing.stream(spark, f"{work}/listing")
        rows.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(
            availableNow=True).foreachBatch(take).start().awaitTermination()
        return sorted(p for b in batches for p in b)

    def extend():
        return listing.extend(spark, str(root), OPTIONS, f"{work}/listing", max_files=6, settle_seconds=0)

    assert extend() == 20
    assert run() == sorted(f"d{i % 3}/f{i}.txt" for i in range(20))
    assert len(batches) == 4 and max(map(len, batches)) == 6
    _tree(root, ["new/a.txt", "d0/f0.txt"])
    os.utime(root / "d0" / "f3.txt", (1, 1))  # an old mtime does not hide a change
    assert extend() == 3
    assert run() == ["d0/f0.txt", "d0/f3.txt", "new/a.txt"]
    assert extend() == 0 and run() == []


def test_unfinished_window_is_listed_again(spark, tmp_path, monkeypatch):
    root, path = tmp_path / "tree", new_work_path(spark, "test-listing")
    _tree(root, ["a.txt"])
    with monkeypatch.context() as patch:
        patch.setattr(listing, "write_chunks", lambda files, at, *limits: files.write.parquet(at) or 1 / 0)
        with pytest.raises(ZeroDivisionError):
            listing.extend(spark, str(root), OPTIONS, path, settle_seconds=0)
    assert listing.extend(spark, str(root), OPTIONS, path, settle_seconds=0) == 1
    assert len(listing._windows(spark, path)[0]) == 1 and listing._windows(spark, path)[1] == []


def test_small_chunks_share_a_file(spark):
    files = spark.createDataFrame([(f"p{i}", 10, i) for i in range(47)], "path STRING, size LONG, mtime_us LONG")
    path = new_work_path(spark, "test-together")
    listing.write_chunks(files, path, 2, 10**9, together=5)
    assert sorted(int(n[5:]) for n in folders(spark, path) if n.startswith("file=")) == list(range(5))
    seen = []
    listing.chunk_stream(spark, path, "path STRING, size LONG, mtime_us LONG, chunk LONG").writeStream.option(
        "checkpointLocation", f"{path}-cp").trigger(availableNow=True).foreachBatch(
        lambda batch, _: seen.append(sorted((r["chunk"], r["mtime_us"]) for r in batch.collect()))
    ).start().awaitTermination()
    assert len(seen) == 5 and sum(seen, []) == [(i // 2, i) for i in range(47)]
    with pytest.raises(ValueError):
        listing.write_chunks(files, path, together=0)
