"""Analysis as a stream: the batch cascade on a streaming files table."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators import analysis, cache, summary
from arborlake.options import ScanOptions
from arborlake.plans.analysis import analyse_incremental, stored_form
from arborlake.schema import ENTRIES
from arborlake.session import delete_folder, is_written, materialise
from arborlake.sources.cache_table import CacheTable

log = logging.getLogger(__name__)

STATUS_INTERVAL = "500 milliseconds"
AVAILABLE_NOW = {"availableNow": True}


def entry_stream(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Entries as soon as their files arrive; the same columns as in batch."""
    included = analysis.traversed(files, options).filter(~F.col("name_excluded"))
    return analysis.entries(included, options)


def marked_stream(files: DataFrame, options: ScanOptions, keep: tuple[str, ...] = ()) -> DataFrame:
    """``entry_stream`` plus a row for each file that a name rule leaves out.

    Such a row has its path, ``name_excluded`` and the columns ``keep`` only; a summary counts it.
    """
    rows = analysis.traversed(files, options)
    for column in ("text", "content"):
        if column in rows.columns:
            rows = rows.withColumn(column, F.when(~F.col("name_excluded"), F.col(column)))
    marked = analysis.entries(rows, options, keep=("name_excluded", *keep))
    named = ("path", "parent", "filename", "name_excluded", *keep)
    return marked.withColumns({
        c: F.when(~F.col("name_excluded"), F.col(c)) for c in marked.columns if c not in named})


def write_entries(
    entries: DataFrame, path: str, checkpoint: str, *, fmt: str = "json", trigger: dict | None = None
) -> StreamingQuery:
    """File sink with commit log: what was committed stays whole after a failure or a stop."""
    return (
        entries.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start(path)
    )


def _committed(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    schema = f"{ENTRIES}, name_excluded BOOLEAN"
    return spark.read.schema(schema).format(fmt).load(path).withColumn(
        "name_excluded", F.coalesce("name_excluded", F.lit(False)))


def committed_entries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """What a streaming sink has committed so far."""
    return _committed(spark, path, fmt).filter(~F.col("name_excluded")).drop("name_excluded")


def committed_summary(
    spark: SparkSession, path: str, *, fmt: str = "json", stopped_early: bool = False,
    hash_algorithm: str | None = None,
) -> DataFrame:
    """Summary after the last entry, over the committed rows.

    Excluded files are counted where the sink holds a ``marked_stream``.
    """
    return summary.run_summary(
        _committed(spark, path, fmt), stopped_early=stopped_early, hash_algorithm=hash_algorithm)


def stop_and_summarise(
    query: StreamingQuery, spark: SparkSession, path: str, **options
) -> DataFrame:
    """Early stop: finished results stay, the summary is marked."""
    query.stop()
    return committed_summary(spark, path, stopped_early=True, **options)


class StopRequested(Exception):
    """Raised inside a batch when a run is to end before it."""


def write_until(
    entries: DataFrame, path: str, checkpoint: str, stop: Callable[[int], bool], *,
    fmt: str = "json", trigger: dict | None = None, chunk: str | None = None,
) -> bool:
    """Write batch by batch until ``stop`` (asked with the number of each next batch) says so.

    True when the run ended early. The batches before stay; a later call with the same checkpoint goes
    on with the batch that was not written. ``committed_summary`` sums up what is there. Where one batch
    of the stream has several chunks of a listing, ``chunk`` is the column of their numbers: each is
    asked for and written as a batch of its own, and not again if the call before wrote it.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        numbers = [batch_id] if chunk is None else sorted(
            row[0] for row in batch.select(chunk).distinct().collect())  # as many as a file of the listing has
        for number in numbers:
            target = f"{path}/batch={number}"
            if chunk is not None and is_written(batch.sparkSession, target):
                continue
            if stop(number):
                raise StopRequested(f"before batch {number}")
            rows = batch if chunk is None else batch.filter(F.col(chunk) == number).drop(chunk)
            rows.write.mode("overwrite").format(fmt).save(target)

    query = (
        entries.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW)).foreachBatch(keep).start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as problem:
        if StopRequested.__name__ in str(problem):
            return True
        raise
    return False


def progress(entries: DataFrame, run: str) -> DataFrame:
    """Running counts per run; written in update mode they are the live progress."""
    failed = F.col("type") == "error"
    return entries.groupBy(run).agg(
        F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"))


def _counts(at: Column, estimate: Column) -> dict[str, Column]:
    failed = F.col("type") == "error"
    return {"processed": F.count_if(~failed), "failed": F.count_if(failed), "_estimate": F.max(estimate),
            "_first": F.min(at), "_last": F.max(at)}


_TOTALS = {"processed": F.sum, "failed": F.sum, "_estimate": F.max, "_first": F.min, "_last": F.max}


def _shown(counts: DataFrame, run: str) -> DataFrame:
    done = F.col("processed") + F.col("failed")
    total = F.greatest(F.col("_estimate"), done).cast("long")
    speed = summary.throughput(done, total, F.col("_last") - F.col("_first"))
    return counts.select(
        run, "processed", "failed", total.alias("estimated_total_files"),
        *[column.alias(name) for name, column in speed.items()],
        summary.progress_percent(done, total).alias("percent"))


def live_progress(entries: DataFrame, run: str, *, at: Column, estimate: Column) -> DataFrame:
    """Counts, rate and remaining time of each run, as of its last batch.

    ``at`` is the time of a row in seconds and ``estimate`` the number of files expected when it was
    made; the estimate that is shown only grows, and is never below what was delivered. All of it is
    one streaming aggregation of sums, minima and maxima, so a run of any size is combined before it is
    shuffled, and the state holds one row a run.
    """
    return _shown(entries.groupBy(run).agg(*[c.alias(n) for n, c in _counts(at, estimate).items()]), run)


def report_chunks(
    entries: DataFrame, run: str, chunk: str, path: str, checkpoint: str, *, at: Column, estimate: Column,
    trigger: dict | None = None,
) -> StreamingQuery:
    """``live_progress`` as of each chunk, for batches of several: a row for each run that a chunk changed.

    Reports go to ``reports`` in ``path``. A batch is counted by run and chunk, and its few counts are
    summed up in the order of chunks behind the totals of the batch before, one row a run in ``totals``;
    a repeated batch starts from the same totals and overwrites what it wrote.
    """
    def report(batch: DataFrame, batch_id: int) -> None:
        spark, totals = batch.sparkSession, f"{path}/totals/batch="
        new = batch.groupBy(run, chunk).agg(*[c.alias(n) for n, c in _counts(at, estimate).items()])
        new = materialise(new, "chunk-counts").withColumn("_new", F.lit(True))
        if batch_id:
            held = spark.read.schema(new.drop(chunk, "_new").schema).parquet(f"{totals}{batch_id - 1}")
            new = new.unionByName(held.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        upto = Window.partitionBy(run).orderBy("_new", chunk).rowsBetween(Window.unboundedPreceding, 0)
        _shown(new.withColumns({n: total(n).over(upto) for n, total in _TOTALS.items()}).filter("_new"), run
               ).write.mode("overwrite").parquet(f"{path}/reports/batch={batch_id}")
        new.groupBy(run).agg(*[total(n).alias(n) for n, total in _TOTALS.items()]
                             ).write.mode("overwrite").parquet(f"{totals}{batch_id}")
        delete_folder(spark, f"{totals}{batch_id - 2}")

    return (
        entries.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW)).foreachBatch(report).start()
    )


def status(progress_rows: DataFrame, handle: Callable[[DataFrame, int], None],
           checkpoint: str) -> StreamingQuery:
    """At most one status per half second, each with the counts that changed."""
    return (
        progress_rows.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=STATUS_INTERVAL)
        .foreachBatch(guarded(handle))
        .start()
    )


def guarded(callback: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A user's function on every batch; its failure is logged and does not stop the run."""
    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            callback(batch, batch_id)
        except Exception:
            log.exception("callback failed on batch %s", batch_id)
    return run


def reanalyse(
    files: DataFrame,
    state: CacheTable,
    options: ScanOptions,
    load_content: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    compact_beyond: int = 20,
    root: str = "",
) -> StreamingQuery:
    """Incremental analysis: unchanged files come from the state, the others are read and kept.

    Per batch: probe, analyse the misses, write the batch's entries, then add the new results
    to the state under the batch id, if there are any. A repeated batch overwrites its own output and is not
    applied twice. Payloads are read for the mtimes of a batch only, and the state is compacted once more than
    ``compact_beyond`` writes have doubled it, so neither grows with the batches before; its keys are
    read whole. ``root`` is the full path that the files' paths are relative to; trees
    that share a state table need it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        # metadata only, and written once: listing a tree again could give other rows
        listed = materialise(latest_of_batch(batch), "listed")
        stored = state.below(root, cache.spans(listed, "mtime_us"))
        result = analyse_incremental(listed, stored, options, load_content)
        target = f"{path}/batch={batch_id}"
        result.entries.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.schema(result.entries.schema).parquet(target)
        fresh = stored_form(written.filter("NOT from_state"))
        if not fresh.isEmpty() and stored.upsert(fresh, f"{checkpoint}:{batch_id}"):
            state.compact_beyond(compact_beyond, f"{checkpoint}:{batch_id}:compact", doubled=True)

    return (
        files.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .foreachBatch(run)
        .start()
    )


def latest_of_batch(batch: DataFrame) -> DataFrame:
    """A file changed twice within a batch counts with its last state."""
    return cache.last_wins(batch, "path", F.col("mtime_us").desc())
