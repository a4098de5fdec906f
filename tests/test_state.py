"""State table, incremental analysis and the ordered operators under skew."""

import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import analysis, cache, ordering, runs, tree
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse_incremental, stored_form
from arborlake.plans.analysis import analyse
from arborlake.schema import CACHE
from arborlake.session import new_work_path
from arborlake.sources.state_table import StateTable

OPTIONS = ScanOptions(excluded_folders=(), excluded_files=(), exclude_patterns=(),
                      max_file_size=100, detect_charset=False, hash_algorithm="md5")


@pytest.fixture
def table(spark):
    return StateTable(spark, new_work_path(spark, "test-state"), "k STRING, v BIGINT", "k")


def pairs(spark, values):
    return spark.createDataFrame(list(values.items()), "k STRING, v BIGINT")


def current(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def test_state_table(spark, table):
    assert current(table) == {} and table.bytes_on_disk() == 0
    assert table.upsert(pairs(spark, {"a": 1, "b": 1}), "b1")
    assert table.upsert(pairs(spark, {"b": 2, "c": 2}), "b2")
    assert current(table) == {"a": 1, "b": 2, "c": 2}
    assert not table.upsert(pairs(spark, {"a": 99}), "b2")
    assert table.compact("c1", partitions=1) > 0
    assert current(table) == {"a": 1, "b": 2, "c": 2} and len(table._live_versions()) == 1
    assert table.upsert(pairs(spark, {"a": 3}), "b3")
    assert current(table)["a"] == 3
    assert table.replace(table.read().filter("k <> 'c'"), "o1")
    assert current(table) == {"a": 3, "b": 2}


def test_compaction_by_number_of_versions(spark, table):
    for i in range(3):
        table.upsert(pairs(spark, {"a": i, f"k{i}": i}), f"b{i}")
    assert not table.compact_beyond(3, "c") and table.compact_beyond(2, "c")
    assert len(table._live_versions()) == 1
    assert current(table) == {"a": 2, "k0": 0, "k1": 1, "k2": 2}


def test_uncommitted_version_is_ignored(spark, table):
    table.upsert(pairs(spark, {"a": 1}), "b1")
    pairs(spark, {"a": 7}).write.parquet(f"{table.path}/data/version=2")
    assert current(table) == {"a": 1}
    table.upsert(pairs(spark, {"z": 5}), "b2")
    assert current(table) == {"a": 1, "z": 5}


def test_incremental_reads_only_misses(spark, files):
    first = files({"a.txt": b"one", "b.txt": b"two", "c.png": b"x", "big.txt": b"z" * 200})
    stored = stored_form(analysis.entries(first, OPTIONS, keep=["mtime_us"]))
    assert {r["path"] for r in stored.collect()} == {"a.txt", "b.txt"}
    now = files({"a.txt": b"one", "b.txt": b"two!", "c.png": b"x", "n.txt": b"new",
                 "big.txt": b"z" * 200})
    opened = []

    def load(missing):
        opened.extend(r["path"] for r in missing.select("path").collect())
        return missing.join(now.select("path", "content"), "path")

    result = analyse_incremental(now.drop("content"), stored, OPTIONS, load)
    assert sorted(opened) == ["b.txt", "c.png", "n.txt"]
    rows = {r["path"]: r for r in result.entries.collect()}
    assert len(rows) == 5 and rows["a.txt"]["content"] == "one"
    assert rows["big.txt"]["reason"] == "file_size"
    assert [r["path"] for r in result.reused.collect()] == ["a.txt"]


def test_hash_validation_finds_silent_changes(spark, files):
    """Same size and mtime, other bytes: only the hash tells."""
    before, after = files({"a.txt": b"one", "b.txt": b"two"}), files({"a.txt": b"one", "b.txt": b"TWO"})
    stored = stored_form(analysis.entries(before, OPTIONS, keep=["mtime_us"]))

    def processed(validate):
        options = dataclasses.replace(OPTIONS, cache_validate=validate)
        result = analyse_incremental(
            after.drop("content"), stored, options,
            lambda missing: missing.join(after.select("path", "content"), "path"))
        assert result.entries.count() == 2
        return {r["path"] for r in result.processed.collect()}

    assert processed("stat") == set() and processed("hash") == {"b.txt"}


def test_corrupt_payload_is_a_miss(spark):
    rows = [("a", "h", '{"t":1}', 1, 1), ("b", "h", '{"t":1', 1, 1), ("c", "h", '{} x', 1, 1)]
    stored = spark.createDataFrame(rows, CACHE)
    now = spark.createDataFrame([(p, 1, 1) for p in "abc"], "path STRING, size BIGINT, mtime_us BIGINT")
    assert [r["path"] for r in cache.hits(now, stored).collect()] == ["a"]
    assert {r["path"] for r in cache.misses(now, stored).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        cache.hits(now, stored, "age")


def test_eviction_keeps_the_newest_share(spark):
    rows = [(f"p{i:03d}", "h", "x" * 10, 1, i // 2) for i in range(200)]
    stored = spark.createDataFrame(rows, CACHE)
    kept = {r["path"] for r in cache.evict(stored, limit_bytes=1000).collect()}
    want = cache.rows_to_keep(200, 2000, 1000)
    assert want == 75 and kept == {r[0] for r in rows[-75:]}
    assert cache.evict(stored, limit_bytes=10_000) is stored


@pytest.mark.parametrize("times", [
    lambda i: i, lambda i: i // 2000, lambda i: 7, lambda i: None if i % 3 else i, lambda i: None])
def test_newest_rows_equal_brute_force(spark, monkeypatch, times):
    rows = [(f"p{i * 7919 % 5000:04d}", times(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "path STRING, mtime_us BIGINT").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    sorted_rows = []
    real = ordering.numbered
    monkeypatch.setattr(ordering, "numbered", lambda frame, *a, **k: sorted_rows.append(
        frame.count()) or real(frame, *a, **k))
    for n in (0, 1, 1234, 4999, 5000, 9999):
        got = {r["path"] for r in ordering.newest_rows(df, n).collect()}
        assert got == {r[0] for r in ordered[max(0, 5000 - n):]}, n
    if times(4000) == 4000:
        assert max(sorted_rows) <= 10  # of 5000 distinct times


def test_newest_rows_survive_a_wrong_sketch(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id AS mtime_us", "CAST(id AS STRING) AS path")
    for wrong in ([0, 1], [998, 999], [2000, 3000], [-9, -5]):
        monkeypatch.setattr(F, "percentile_approx", lambda *a: F.array(*map(F.lit, wrong)))
        assert sorted(r["mtime_us"] for r in ordering.newest_rows(df, 300).collect()) == list(range(700, 1000))


def skewed(spark, n=5000):
    """One key holds more than a third of the rows; times repeat."""
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.randrange(500))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "id BIGINT, k STRING, t BIGINT").repartition(16)


def test_numbering_equals_brute_force(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["rn"] for r in ordering.numbered(df, ["t", "id"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(ordered, 1)}
    within = {r["id"]: r["rn"] for r in ordering.numbered(df, ["t", "id"], ["k"]).collect()}
    seen, want = {}, {}
    for row in ordered:
        seen[row[1]] = want[row[0]] = seen.get(row[1], 0) + 1
    assert within == want
    chunks = {r["id"]: r["chunk"] for r in ordering.chunk_index(df, ["t", "id"]).collect()}
    assert chunks == {k: (v - 1) // 256 for k, v in got.items()}


def test_hot_key_is_spread_over_partitions(spark):
    _, df = skewed(spark)
    ranged = df.repartitionByRange(8, "k", "t", "id").withColumn("p", F.spark_partition_id())
    assert ranged.filter("k = 'hot'").select("p").distinct().count() > 1


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_last_n_equals_brute_force(spark, n):
    rows, df = skewed(spark)
    got = {r["id"] for r in ordering.last_n(df, "k", [F.col("t").desc(), F.col("id").desc()], n)
           .collect()}
    by_key = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        by_key.setdefault(row[1], []).append(row[0])
    assert got == {i for ids in by_key.values() for i in ids[:n]}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_navigation_wraps(spark, n):
    df = spark.createDataFrame([(i, 10 - i) for i in range(n)], "id BIGINT, t BIGINT")
    rows = {r["position"]: r for r in ordering.navigation(df, "id", ["t", "id"]).collect()}
    ids = list(range(n))[::-1]
    for place in range(1, n + 1):
        row = rows[place]
        assert (row["id"], row["previous_id"], row["next_id"]) == (
            ids[place - 1], ids[place - 2], ids[place % n])


def test_last_wins_limits_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = cache.last_wins(df, "k", F.col("t").desc(), F.col("id").desc())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_history_upsert_keeps_position(spark):
    rows = [("x", 1, "a"), ("y", 2, "b"), ("x", 3, "c")]
    df = spark.createDataFrame(rows, "id STRING, seq BIGINT, v STRING")
    got = {r["id"]: (r["position"], r["v"]) for r in
           cache.upsert_keeping_position(df, "id", "seq").collect()}
    assert got == {"x": (1, "c"), "y": (2, "b")}


def test_diff(spark):
    schema = "path STRING, a BIGINT, b STRING"
    left = spark.createDataFrame([("p", 1, None), ("q", 1, "x"), ("r", 1, "x")], schema)
    right = spark.createDataFrame([("p", 1, None), ("q", 2, None), ("s", 1, "x")], schema)
    diff = runs.diff_results(left, right, ("a", "b"))
    got = {(r["path"], r["status"], r["column"], r["old_value"], r["new_value"])
           for r in diff.collect()}
    assert got == {("p", "same", None, None, None), ("q", "changed", "a", "1", "2"),
                   ("q", "changed", "b", "x", None), ("r", "removed", None, None, None),
                   ("s", "added", None, None, None)}
    assert runs.differ(diff) and not runs.differ(runs.diff_results(left, left, ("a", "b")))


def test_comparison_of_different_runs(spark):
    rows = [(1, "A", "r", None, "json", 1.5, 3, None), (2, "B", "r", "p", "csv", None, None, "m")]
    df = spark.createDataFrame(
        rows, "identifier BIGINT, display_name STRING, repository STRING, preset STRING, "
        "output_format STRING, duration_seconds DOUBLE, processed_files BIGINT, hash STRING"
    ).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    ids = spark.createDataFrame([(1, 2)], "left_id BIGINT, right_id BIGINT")
    got = {r["metric"]: (r["left"], r["right"]) for r in
           runs.compare_metrics(df, ids, ("hash",)).collect()}
    assert got["Duration (s)"] == ("1.50", "") and got["Preset"] == ("default", "p")
    assert got["Summary: hash"] == ("", "m") and got["Files"] == ("3", "")
    report = {r["identifier"]: r["report"] for r in runs.report_text(df, ("hash",)).collect()}
    assert "Summary metrics" not in report[1] and report[2].endswith("\n\nSummary metrics:\n- hash: m")


def test_directories_of_a_wide_tree(spark, files):
    entries = files({f"d/{i}": b"" for i in range(300)} | {"d/e/f": b""}).withColumn(
        "type", F.lit("text"))
    assert {r["path"]: r["depth"] for r in tree.directories(entries).collect()} == {"d": 1, "d/e": 2}
    assert tree.edges(entries).count() == 302


def test_stored_form_is_json(spark, files):
    entries = analyse(files({"a.txt": b"x"}), OPTIONS).entries.withColumn("mtime_us", F.lit(1))
    row = stored_form(entries).first()
    assert json.loads(row["file_info"])["content"] == "x" and row["path"] == "a.txt"


def test_vacuum_deletes_replaced_versions(spark, tmp_path):
    state = StateTable(spark, str(tmp_path / "t"), "k BIGINT, v BIGINT", "k")
    for i in range(3):
        state.upsert(spark.createDataFrame([(1, i), (10 + i, i)], state.schema), f"b{i}")
    assert state.vacuum() == 0
    before = sorted(tuple(r) for r in state.read().collect())
    state.compact("c")
    assert state.vacuum() == 3 and sorted(tuple(r) for r in state.read().collect()) == before
    assert [p.name for p in (tmp_path / "t" / "data").iterdir() if p.is_dir()] == ["version=4"]


def test_eviction_moves_keys_only(spark):
    columns = "path STRING, file_hash STRING, file_info STRING, size BIGINT, mtime_us BIGINT"
    rows = [(f"p{i:03}", "h", "x" * 100, 100, i // 2) for i in range(100)]
    kept = cache.evict(spark.createDataFrame(rows, columns), limit_bytes=5000)
    assert sorted(r["path"] for r in kept.collect()) == [f"p{i:03}" for i in range(63, 100)]
