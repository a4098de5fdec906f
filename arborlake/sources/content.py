"""Reading file contents in tasks, bounded in bytes per file and per Arrow batch."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from arborlake.functions.content import xxhash
from arborlake.options import ScanOptions

CHUNK_BYTES = 256 * 1024
BATCH_BYTES = 64 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024


def _hasher(algorithm: str | None):
    if algorithm == "md5":
        return hashlib.md5()
    if algorithm == "sha256":
        return hashlib.sha256()
    if algorithm == "xxh64":
        return xxhash.xxh64() if xxhash is not None else hashlib.blake2b(digest_size=8)
    return None


def _read(location: str, limit: int, algorithm: str | None) -> tuple:
    """First ``limit`` bytes, hash of all bytes, error text."""
    hasher = _hasher(algorithm)
    head = bytearray()
    try:
        with open(location, "rb") as handle:
            while len(head) < limit or hasher is not None:
                chunk = handle.read(CHUNK_BYTES)
                if not chunk:
                    break
                if len(head) < limit:
                    head += chunk[: limit - len(head)]
                if hasher is not None:
                    hasher.update(chunk)
    except OSError as problem:
        return None, None, f"{type(problem).__name__}: {problem}"
    return bytes(head), None if hasher is None else hasher.hexdigest(), None


def _loader(limit: int, max_size: int, algorithm: str | None) -> Callable:
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, held, found = 0, 0, []
            for place, (location, size) in enumerate(zip(batch["location"], batch["size"])):
                unread = pd.isna(size) or size > max_size
                loaded = (None, None, None) if unread else _read(location, limit, algorithm)
                found.append(loaded)
                held += len(loaded[0] or b"")
                if held >= BATCH_BYTES:
                    yield _with(batch.iloc[start:place + 1], found)
                    start, held, found = place + 1, 0, []
            if found:
                yield _with(batch.iloc[start:], found)
    return load


def _with(rows: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
    contents, digests, errors = zip(*found)
    return rows.assign(content=list(contents), digest=list(digests), read_error=list(errors))


def with_content(files: DataFrame, options: ScanOptions) -> DataFrame:
    """Add ``content, digest, read_error`` to rows with ``location`` and ``size``.

    Streams keep the partitions of their source. A batch is spread by its bytes first: the
    listing's partitions follow directories, which may be of any size.
    """
    limit = max(options.text_limit, options.binary_limit)
    if not files.isStreaming:
        readable = F.when(F.col("size") <= options.max_file_size, F.col("size"))
        total = files.agg(F.sum(readable)).first()[0] or 0
        files = files.repartition(max(1, math.ceil(total / TASK_BYTES)))
    schema = T.StructType(files.schema.fields + [
        T.StructField("content", T.BinaryType()),
        T.StructField("digest", T.StringType()),
        T.StructField("read_error", T.StringType()),
    ])
    return files.mapInPandas(
        _loader(limit, options.max_file_size, options.hash_algorithm), schema)


def files_of_binary(binary: DataFrame, root: str) -> DataFrame:
    """``spark.read.format("binaryFile")`` rows as files with content, for object stores.

    That format leaves out names starting with ``_`` or ``.`` and knows no mode.
    """
    path = F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 2))
    return binary.select(
        path.alias("path"),
        F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))
        .otherwise(F.lit("")).alias("parent"),
        F.substring_index(path, "/", -1).alias("filename"),
        F.col("length").alias("size"),
        F.unix_micros("modificationTime").alias("mtime_us"),
        F.lit(None).cast("long").alias("created_us"),
        F.lit(None).cast("long").alias("mode"),
        F.lit(None).cast("string").alias("stat_error"),
        F.col("path").alias("location"),
        "content",
    )
