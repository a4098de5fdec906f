"""The state as a bucketed table: commits, probes that leave payloads alone, upkeep."""

import re

import pytest
from pyspark.sql import functions as F

from arborlake.operators.cache import spans
from arborlake.schema import CACHE
from arborlake.session import folders, new_work_path
from arborlake.sources.cache_table import CacheTable


@pytest.fixture
def state(spark):
    return CacheTable(spark, new_work_path(spark, "test-state"), buckets=4)


def rows(spark, values):
    return spark.createDataFrame(values, CACHE)


def row(path, info="{}", mtime=1, size=1):
    return (path, "h", info, size, mtime)


def files(spark, values):
    return spark.createDataFrame(values, "path STRING, size BIGINT, mtime_us BIGINT")


def current(state):
    return {r["path"]: r["file_info"] for r in state.read().collect()}


def test_writes_and_snapshots(spark, state):
    assert current(state) == {} and state.accounting() == (0, 0)
    assert state.upsert(rows(spark, [row("a", "[1]"), row("b", "[1]")]), "1")
    assert state.upsert(rows(spark, [row("b", "[2]"), row("c", "[2]")]), "2")
    assert not state.upsert(rows(spark, [row("a", "[9]")]), "2")
    assert current(state) == {"a": "[1]", "b": "[2]", "c": "[2]"}
    assert state.accounting() == (3, 9)
    assert not state.compact_beyond(2, "c") and state.compact_beyond(1, "c")
    assert current(state) == {"a": "[1]", "b": "[2]", "c": "[2]"} and len(state._live()) == 1
    assert state.vacuum() == 1 and state.vacuum() == 0
    assert [f for f in folders(spark, state.path) if f.startswith("base=")] == ["base=3"]
    again = CacheTable(spark, state.path, buckets=16)  # the first snapshot has fixed the buckets
    assert again.upsert(rows(spark, [row("d")]), "3")
    assert set(current(again)) == {"a", "b", "c", "d"}


def test_uncommitted_rows_are_not_seen(spark, state, monkeypatch):
    state.upsert(rows(spark, [row("a", "[1]")]), "1")
    with monkeypatch.context() as patch:
        patch.setattr(state.spark, "createDataFrame", lambda *a: 1 / 0)  # dies before the commit
        with pytest.raises(ZeroDivisionError):
            state.upsert(rows(spark, []).union(spark.sql("SELECT 'a', 'h', '[2]', 1L, 1L")), "2")
    assert current(state) == {"a": "[1]"}
    assert state.upsert(rows(spark, [row("a", "[3]")]), "2")
    assert current(state) == {"a": "[3]"}


def test_probes(spark, state):
    state.below("/x/").upsert(rows(spark, [
        row("a"), row("b", "{"), row("c", "{} x"), row("d", None), row("e", mtime=2), row("f")]), "1")
    state.below("/y").upsert(rows(spark, [row("a", "[1]")]), "2")
    now = files(spark, [(p, 1, 1) for p in "abcdeg"] + [("f", None, 1)])
    assert [(r["path"], r["file_info"]) for r in state.below("/x").hits(now).collect()] == [("a", "{}")]
    assert sorted(r["path"] for r in state.below("/x").misses(now).collect()) == list("bcdefg")
    assert [r["file_info"] for r in state.below("/y").hits(now).collect()] == ["[1]"]
    assert state.below("").misses(now).count() == 7
    hashed = now.withColumn("file_hash", F.when(F.col("path") == "a", "h").otherwise("other"))
    assert [r["path"] for r in state.below("/x").hits(hashed, "hash").collect()] == ["a"]
    assert state.below("/x").misses(hashed, "hash").count() == 6
    with pytest.raises(ValueError):
        state.below("/x").hits(now, "age")


def test_probes_shuffle_files_only(spark, state):
    """No payload and no JSON in a probe; the state stays in its buckets, for payloads too."""
    for i in range(3):
        state.upsert(rows(spark, [row(f"p{j}") for j in range(200)]), str(i))
    now = files(spark, [(f"p{j}", 1, 1) for j in range(200)])
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for probe, exchanges in ((state.below("").misses(now), 1), (state.below("").hits(now), 1)):
            plan = probe._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == exchanges
            assert "parse_json" not in plan and "Bucketed: true" in plan
            assert "mtime_us" in plan[plan.index("Exchange"):]
        misses = state.below("").misses(now)._jdf.queryExecution().executedPlan().toString()
        assert "file_info" not in misses
        assert state.below("").hits(now).count() == 200
    finally:
        spark.conf.set(threshold, before)


def test_snapshots_stay_in_proportion_to_the_rows_written(spark, state):
    for i in range(1, 14):
        state.upsert(rows(spark, [row(f"p{i}", f"[{i}]", mtime=i)]), str(i))
        state.compact_beyond(2, f"{i}:compact", doubled=True)
    snapshots = [r["batch"] for r in state._commits().filter("kind = 'snapshot'").collect()]
    assert sorted(snapshots, key=lambda b: int(b.split(":")[0])) == ["1", "3:compact", "7:compact"]
    assert current(state) == {f"p{i}": f"[{i}]" for i in range(1, 14)}


def test_payloads_are_looked_up_by_mtime(spark, state):
    state.upsert(rows(spark, [row(f"p{i}", f"[{i}]", mtime=10 * i) for i in range(50)]), "1")
    state.upsert(rows(spark, [row("p7", "[70]", mtime=71)]), "2")
    now = files(spark, [(f"p{i}", 1, 10 * i) for i in (0, 1, 2, 7, 40)] + [("q", 1, None)])
    ranges = spans(now, "mtime_us")
    assert ranges == [(0, 20), (70, 70), (400, 400)] and spans(now.filter("path = 'q'"), "mtime_us") == []
    below = state.below("", ranges)
    plan = below.hits(now)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"mtime_us#\d+L <= 20\)", plan)
    assert {r["path"]: r["file_info"] for r in below.hits(now).collect()} == {
        "p0": "[0]", "p1": "[1]", "p2": "[2]", "p40": "[40]"}  # p7 was stored anew with another mtime
    assert below.misses(now).count() == 2
    below.upsert(rows(spark, [row("q", "[9]", mtime=20)]), "3")
    assert [r["file_info"] for r in below.hits(files(spark, [("q", 1, 20)])).collect()] == ["[9]"]


def test_upkeep(spark, state):
    state.below("/x").upsert(rows(spark, [row(f"p{i}", "x" * 10, mtime=i) for i in range(40)]), "1")
    state.below("/y").upsert(rows(spark, [row(f"p{i}", "x" * 10, mtime=100 + i) for i in range(10)]), "2")
    now = files(spark, [(f"p{i}", 1, i) for i in range(10, 40)])
    done = state.upkeep(now, "/x", "run", limit_bytes=200, writes=5)
    assert done == ["orphans", "evict", "vacuum"]
    assert set(current(state)) == {f"/y/p{i}" for i in range(10)} | {f"/x/p{i}" for i in range(35, 40)}
    assert state.upkeep(now, "/x", "run 2", limit_bytes=200) == []
