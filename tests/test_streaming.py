"""Streams: equal to batch, restartable, guarded and routed."""

import logging

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrameWriter, functions as F

from arborlake.operators import analysis
from arborlake.options import ScanOptions
from arborlake.plans import views
from arborlake.plans.analysis import analyse
from arborlake.plans.catalog.streams import content_loader
from arborlake.schema import LOGS
from arborlake.session import new_work_path
from arborlake.sources import content, filetree, listing
from arborlake.sources.cache_table import CacheTable
from arborlake.sources.state_table import StateTable
from arborlake.streaming import entries as streams, logs as stream_logs

SF = "/root/testdata/sf0.001"
OPTIONS = ScanOptions(detect_charset=False, hash_algorithm="md5")
WAIT = 120


@pytest.fixture
def parts(spark):
    """Documents as several files, read one per batch."""
    folder = new_work_path(spark, "test-parts")
    docs = views.table(spark, SF, "documents")
    docs.repartition(4).write.parquet(folder)
    schema = docs.schema

    def stream():
        return views.as_files(spark.readStream.schema(schema).option(
            "maxFilesPerTrigger", 1).parquet(folder))

    return stream


@pytest.fixture
def work(spark):
    return new_work_path(spark, "test-stream")


def finish(query):
    assert query.awaitTermination(WAIT)


def keyed(df):
    return {r["path"]: (r["type"], r["hash"], r["size"]) for r in df.collect()}


def test_stream_equals_batch_and_restart_adds_nothing(spark, parts, work):
    for _ in range(2):
        finish(streams.write_entries(
            streams.entry_stream(parts(), OPTIONS), f"{work}/out", f"{work}/cp"))
    got = streams.committed_entries(spark, f"{work}/out")
    want = analyse(views.files(spark, SF), OPTIONS).entries
    assert got.count() == want.count() and keyed(got) == keyed(want)


def test_results_arrive_batch_by_batch_and_stop_keeps_them(spark, parts, work):
    counts = []
    query = (
        streams.entry_stream(parts(), OPTIONS).writeStream
        .option("checkpointLocation", f"{work}/cp")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, i: counts.append(batch.count()))
        .start()
    )
    finish(query)
    assert len(counts) == 4 and all(counts)
    sink = streams.write_entries(
        streams.entry_stream(parts(), OPTIONS), f"{work}/out", f"{work}/cp2",
        trigger={"processingTime": "0 seconds"})
    sink.processAllAvailable()
    row = streams.stop_and_summarise(sink, spark, f"{work}/out", hash_algorithm="md5").first()
    assert row["stopped_early"] and row["included_files"] == sum(counts)


def test_the_summary_of_a_stream_counts_what_name_rules_leave_out(spark, parts, work):
    options = ScanOptions(detect_charset=False, hash_algorithm="md5", exclude_patterns=("*1*",))
    finish(streams.write_entries(
        streams.marked_stream(parts(), options), f"{work}/out", f"{work}/cp"))
    got = streams.committed_summary(spark, f"{work}/out", hash_algorithm="md5").first()
    want = analyse(views.files(spark, SF), options)
    assert got.asDict() == want.summary().first().asDict() and got["excluded_files"] > 0
    assert keyed(streams.committed_entries(spark, f"{work}/out")) == keyed(want.entries)


def test_a_failing_callback_does_not_stop_the_run(spark, parts, work, caplog):
    seen = []

    def callback(batch, batch_id):
        seen.append(batch_id)
        if batch_id == 1:
            raise RuntimeError("user error")

    with caplog.at_level(logging.ERROR):
        query = parts().writeStream.option("checkpointLocation", f"{work}/cp").trigger(
            availableNow=True).foreachBatch(streams.guarded(callback)).start()
        finish(query)
    assert seen == [0, 1, 2, 3] and "callback failed on batch 1" in caplog.text


def test_status_reports_growing_counts(spark, parts, work):
    reports = []
    included = analysis.traversed(parts(), OPTIONS).filter("NOT name_excluded")
    progress = streams.progress(
        analysis.tagged(included, OPTIONS).withColumn("run", F.lit("r")), "run")
    query = streams.status(
        progress, lambda batch, i: reports.extend(r["processed"] for r in batch.collect()),
        f"{work}/cp")
    query.processAllAvailable()
    query.stop()
    want = analyse(views.files(spark, SF), OPTIONS).entries.count()
    assert reports == sorted(reports) and reports[-1] == want


def test_reanalysis_reuses_state(spark, work, tmp_path):
    for name in ("a.txt", "b.txt", "c.py"):
        (tmp_path / name).write_text(f"content of {name}")
    state = CacheTable(spark, f"{work}/state", buckets=4)
    loaded = []

    def load(files):
        loaded.append(files.count())
        return content.with_content(files, OPTIONS)

    def run(turn):
        loaded.clear()
        stream = filetree.scan_stream(spark, str(tmp_path), OPTIONS, settleSeconds="0")
        finish(streams.reanalyse(stream, state, OPTIONS, load, f"{work}/{turn}", f"{work}/cp-{turn}"))
        return {r["path"]: r["content"] for r in spark.read.parquet(f"{work}/{turn}").collect()}

    first = run("one")
    assert first == {n: f"content of {n}" for n in ("a.txt", "b.txt", "c.py")} and sum(loaded) == 3
    (tmp_path / "b.txt").write_text("changed")
    second = run("two")
    assert second == {**first, "b.txt": "changed"} and sum(loaded) == 1
    assert state.read().count() == 3


def test_reanalysis_without_changes_leaves_the_state_alone(spark, work, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text(f"content of {i}")
    listing.extend(spark, str(tmp_path), OPTIONS, f"{work}/listing", max_files=2, settle_seconds=0)
    state = CacheTable(spark, f"{work}/state", buckets=2)

    def run(turn):
        finish(streams.reanalyse(
            listing.stream(spark, f"{work}/listing"), state, OPTIONS,
            lambda files: content.with_content(files, OPTIONS), f"{work}/{turn}", f"{work}/cp-{turn}", compact_beyond=2))
        found = spark.read.parquet(f"{work}/{turn}")
        return sorted(map(tuple, found.select("path", "content", "hash").collect())), found.filter("from_state").count()

    first, reused = run("one")
    writes = state._commits().count()
    assert len(first) == 6 and reused == 0
    assert run("two") == (first, 6) and state._commits().count() == writes


def test_documents_are_read_from_the_files_of_a_batch(spark, work):
    """Texts come from the files that the rows name, and from those with copies of them, not from others."""
    def write(name, rows):
        spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING").coalesce(1).write.parquet(
            f"{work}/{name}")
        spark.read.parquet(f"{work}/{name}").coalesce(1).write.mode("append").parquet(f"{work}/documents.parquet")

    write("a", [(1, "one", "en", "s"), (2, "two", "en", None), (None, "no id", "en", "s")])
    write("b", [(3, "three", "en", "s"), (1, "one", "en", "s")])
    write("c", [(4, "four", "en", "s")])
    load = content_loader(spark, work)
    files = views.as_files(
        views.table(spark, work, "documents"), F.col("_metadata.file_path").alias("place")).drop("text", "content")
    listed = files.localCheckpoint()
    other = listed.filter("doc_id = 4").first()["place"]
    with open(other.removeprefix("file:"), "r+b") as damaged:
        damaged.write(b"none")
    found = load(listed.filter("place <> '" + other + "' AND (doc_id IS NULL OR doc_id < 3)"))
    got = sorted((r["doc_id"] or 0, bytes(r["content"]).decode()) for r in found.collect())
    # document 1 is listed twice, and each has the texts of both files
    assert got == [(0, "no id")] + [(1, "one")] * 4 + [(2, "two")]
    assert load(listed.filter("false")).count() == 0


@pytest.mark.parametrize("place", ["output", "rows", "commit"])
def test_reanalysis_recovers_inside_a_batch(spark, work, tmp_path, monkeypatch, place):
    """A run that dies behind the output, the state's rows or their commit ends like an undisturbed one."""
    for i in range(7):
        (tmp_path / f"f{i}.txt").write_text(f"content of {i}")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG")
    listing.extend(spark, str(tmp_path), OPTIONS, f"{work}/listing", max_files=3, settle_seconds=0)

    def run(turn, state):
        finish(streams.reanalyse(
            listing.stream(spark, f"{work}/listing"), state, OPTIONS,
            lambda files: content.with_content(files, OPTIONS), f"{work}/{turn}", f"{work}/cp-{turn}"))

    def result(turn, state):
        rows = spark.read.parquet(f"{work}/{turn}").select("path", "type", "content", "hash", "batch")
        return sorted(map(tuple, rows.collect())), sorted(map(tuple, state.read().collect()))

    plain, disturbed = (CacheTable(spark, f"{work}/state-{n}", buckets=2) for n in ("plain", "disturbed"))
    run("plain", plain)
    calls = []

    def dying(real, before):
        def call(self, *args, **kwargs):
            calls.append(1)
            if len(calls) == 2 and before:
                raise RuntimeError("killed")
            out = real(self, *args, **kwargs)
            if len(calls) == 2 and not before:
                raise RuntimeError("killed")
            return out
        return call

    with monkeypatch.context() as patch:
        owner, name, before = {
            "output": (CacheTable, "upsert", True), "rows": (DataFrameWriter, "insertInto", False),
            "commit": (CacheTable, "upsert", False)}[place]
        patch.setattr(owner, name, dying(getattr(owner, name), before))
        with pytest.raises(StreamingQueryException):
            run("disturbed", disturbed)
    assert len(spark.read.parquet(f"{work}/disturbed").select("batch").distinct().collect()) == 2
    run("disturbed", disturbed)
    assert result("disturbed", disturbed) == result("plain", plain)
    assert len(result("plain", plain)[0]) == 8


def test_a_stopped_run_goes_on(spark, parts, work):
    def run(stop):
        return streams.write_until(
            streams.marked_stream(parts(), OPTIONS), f"{work}/out", f"{work}/cp", stop, fmt="parquet")

    def total():
        return streams.committed_summary(spark, f"{work}/out", fmt="parquet").first()["total_files"]

    assert run(lambda batch: batch >= 2) is True
    part = total()
    assert run(lambda batch: True) is True and total() == part
    assert run(lambda batch: False) is False
    assert 0 < part < total() == analyse(views.files(spark, SF), OPTIONS).summary().first()["total_files"]


def test_log_routing_delivers_once(spark, work):
    stream = views.log_columns(spark.readStream.schema(
        views.table(spark, SF, "events").schema).parquet(f"{SF}/events*.parquet"))
    once = {"availableNow": True}
    for query in stream_logs.route(stream, f"{work}/u", f"{work}/b", f"{work}/cp",
                                   urgent_trigger=once, batch_trigger=once):
        finish(query)
    urgent = spark.read.schema(LOGS).parquet(f"{work}/u")
    rest = spark.read.schema(LOGS).parquet(f"{work}/b")
    assert urgent.filter("level < 40").isEmpty() and rest.filter("level >= 40").isEmpty()
    both = urgent.unionByName(rest)
    assert both.count() == both.select("seq").distinct().count() == views.logs(spark, SF).count()


def test_rolling_buffer_over_batches(spark, work):
    folder = new_work_path(spark, "test-events")
    events = views.table(spark, SF, "events")
    events.repartitionByRange(3, "event_id").write.parquet(folder)
    stream = views.log_columns(spark.readStream.schema(events.schema).option(
        "maxFilesPerTrigger", 1).parquet(folder))
    state = StateTable(spark, f"{work}/state", LOGS, "seq")
    finish(stream_logs.rolling_buffer(stream, state, f"{work}/cp", 7))
    from arborlake.operators.logs import buffered
    want = {r["seq"] for r in buffered(views.logs(spark, SF), 7).collect()}
    assert {r["seq"] for r in state.read().collect()} == want


def _chunked(spark, work, together):
    """Small chunks of two runs, so many in a file of the listing."""
    rows = [(f"p{i:02d}", 10, i * 500_000, "a" if i % 3 else "b", "error" if i % 7 == 5 else "text")
            for i in range(29)] + [("p29", 10, 29_000_000, None, "text")]
    schema = "path STRING, size LONG, mtime_us LONG, run STRING, type STRING"
    listing.write_chunks(spark.createDataFrame(rows, schema), f"{work}/listing", 4, 10**9, together)
    return listing.chunk_stream(spark, f"{work}/listing", f"{schema}, chunk LONG")


def test_chunks_are_reported_one_by_one(spark, work):
    figures = {"at": F.col("mtime_us") / 1_000_000, "estimate": F.expr("CASE WHEN chunk = 2 THEN 3 ELSE 9 + chunk END")}
    single = _chunked(spark, f"{work}/one", 1)
    progress = streams.live_progress(single, "run", **figures)
    progress.writeStream.outputMode("update").option("checkpointLocation", f"{work}/cp").trigger(
        availableNow=True).foreachBatch(lambda batch, n: batch.write.parquet(f"{work}/want/batch={n}")
                                        ).start().awaitTermination()

    def rows(path):
        return sorted(map(repr, spark.read.schema(progress.schema).parquet(f"{path}/*").collect()))

    want = rows(f"{work}/want")
    for together in (1, 3, 100):
        finish(streams.report_chunks(_chunked(spark, f"{work}/{together}", together), "run", "chunk",
                                     f"{work}/got-{together}", f"{work}/cp-{together}", **figures))
        assert rows(f"{work}/got-{together}/reports") == want
    assert len(want) > 10


def test_a_run_stops_between_chunks_of_a_batch(spark, work):
    rows = _chunked(spark, work, 5)

    def run(stop):
        return streams.write_until(rows, f"{work}/out", f"{work}/cp", stop, fmt="parquet", chunk="chunk")

    def written():
        return sorted(r["batch"] for r in spark.read.parquet(f"{work}/out").select("batch").distinct().collect())

    asked = []
    assert run(lambda chunk: chunk >= 3) is True and written() == [0, 1, 2]
    assert run(lambda chunk: asked.append(chunk) or chunk >= 4) is True and written() == [0, 1, 2, 3]
    assert asked == [3, 4]
    assert run(lambda chunk: False) is False and written() == list(range(8))
    assert spark.read.parquet(f"{work}/out").count() == 30
