"""A written listing of a tree, streamed in batches of bounded size.

Finding files and working on them are two steps. ``extend`` lists what changed since the last time
and appends it to the listing, ordered by (mtime, path) and cut into chunks of at most ``max_files``
files and about ``max_bytes`` bytes, one Parquet file each or, where chunks are small, so many together. ``stream`` reads that folder as a file
stream, so many chunks a batch: Spark's own offset log is the cursor, and after a restart the stream
goes on where it was, however much was found in between. The first batch is as small as any other.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arborlake.operators.ordering import running_sums
from arborlake.options import ScanOptions
from arborlake.session import delete_folder, folders, materialise, stamp_in_order
from arborlake.sources import filetree

MAX_FILES, MAX_BYTES = 100_000, 64 << 30


def in_chunks(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``chunk`` (from 0, in order of mtime and path).

    A chunk has at most ``max_files`` files, and without its last file less than ``max_bytes`` bytes.
    """
    if max_files < 1 or max_bytes < 1:
        raise ValueError("max_files and max_bytes must be positive")
    placed = running_sums(files, ["mtime_us", "path"], {
        "_rows": F.lit(1), "_bytes": F.col("size")}).withColumns({
            "_rows": F.floor(F.col("_rows") / max_files), "_bytes": F.floor(F.col("_bytes") / max_bytes)})
    placed = materialise(placed, "placed")
    cuts = placed.select("_rows", "_bytes").distinct()  # one row a chunk
    cuts = cuts.withColumn("chunk", F.row_number().over(Window.orderBy("_rows", "_bytes")) - 1)
    return placed.join(cuts, ["_rows", "_bytes"]).select(
        *files.columns, F.col("chunk").cast("long").alias("chunk"))


def write_chunks(
    files: DataFrame, path: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, together: int = 1,
) -> None:
    """One file for each ``together`` consecutive chunks, in order: it is bounded, so one task may write it.

    A file costs a task, a folder and a batch of the stream its own time, so small chunks are written together.
    """
    if together < 1:
        raise ValueError("together must be positive")
    spark = files.sparkSession
    rows = in_chunks(files, max_files, max_bytes).withColumn("file", F.floor(F.col("chunk") / together))
    rows.repartition("file").write.partitionBy("file").parquet(path)
    numbers = sorted(int(name[len("file="):]) for name in folders(spark, path) if name.startswith("file="))
    stamp_in_order(spark, [f"{path}/file={number}" for number in numbers])


def _windows(spark: SparkSession, path: str) -> tuple[list[int], list[str]]:
    """Ends of the finished windows, and folders of windows that were not finished."""
    done, cut = [], []
    for name in folders(spark, path):
        if name.startswith("until="):
            finished = any(f == "done" for f in folders(spark, f"{path}/{name}"))
            (done if finished else cut).append(name)
    return [int(n[len("until="):]) for n in done], cut


def extend(
    spark: SparkSession, root: str, options: ScanOptions, path: str, *, max_files: int = MAX_FILES,
    max_bytes: int = MAX_BYTES, settle_seconds: float = 2, **scan_options,
) -> int:
    """Append the files that changed since the last call; returns their number.

    Changes of the last ``settle_seconds`` are left to the next call, so that a file still being
    written is not taken. Of a call that failed half-way the rest is deleted and listed anew: a stream
    that has read a part of it meets those files twice, and ``reanalyse`` finds them in its state.
    """
    done, cut = _windows(spark, path)
    for name in cut:
        delete_folder(spark, f"{path}/{name}")
    until = time.time_ns() // 1000 - int(settle_seconds * 1_000_000)
    after = max(done, default=-1)
    if until <= after:
        return 0
    found = materialise(filetree.scan(
        spark, root, options, changedAfterUs=str(after), changedUntilUs=str(until), **scan_options), "changed")
    number = found.count()
    if number:
        write_chunks(found, f"{path}/until={until}/files", max_files, max_bytes)
        spark.range(1).coalesce(1).write.parquet(f"{path}/until={until}/done")
    return number


def stream(spark: SparkSession, path: str, chunks: int = 1) -> DataFrame:
    """The listed files as a stream, ``chunks`` chunks a batch; ``chunk`` is kept as a column."""
    return chunk_stream(spark, f"{path}/until=*/files", f"{filetree.SCHEMA}, chunk LONG", chunks)


def chunk_stream(spark: SparkSession, path: str, schema, chunks: int = 1) -> DataFrame:
    """A stream over a folder of ``write_chunks``, ``chunks`` of its files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", chunks).option(
        "recursiveFileLookup", "true").parquet(path)
