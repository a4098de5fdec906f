"""Session helpers: a local session for tests and the bench, and the shared work folder."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and bench.py; a cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("arborlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # no Python call sites in error messages: recording them doubles the time to make a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _own_work_dir() -> str:
    return tempfile.mkdtemp(prefix="arborlake-")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting (a local test) gets a temporary folder of its own; a
    cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_work_dir()


_scratch: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


def _application_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/arborlake/{spark.sparkContext.applicationId}"


def new_work_path(spark: SparkSession, label: str) -> str:
    return f"{_application_dir(spark)}{_scratch.get()}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediates made inside are deleted at the end.

    What is to stay has to be written elsewhere inside, to a path that was made before.
    """
    mark = _scratch.set(f"{_scratch.get()}/scratch-{uuid.uuid4().hex}")
    folder = _application_dir(spark) + _scratch.get()
    try:
        yield
    finally:
        _scratch.reset(mark)
        delete_folder(spark, folder)


#: rows of an Arrow batch: texts are long, so few of them
ARROW_ROWS = 1000


def small_arrow_batches(spark: SparkSession) -> None:
    """Few rows in each Arrow batch that goes to Python, so that its memory stays small with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage, survives lost executors and gives every later branch
    of the plan the very same rows, in the very same partitions' ids.
    """
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path objects, for folders in any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in ``path``; none if it is not there."""
    store, place = _hadoop(spark, path)
    if not store.exists(place):
        return []
    return [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()]


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end."""
    store, place = _hadoop(spark, f"{path}/_SUCCESS")
    return store.exists(place)


def stamp_in_order(spark: SparkSession, paths: list[str]) -> None:
    """Give the files of each folder a later modification time than those of the folder before.

    A file stream takes files in that order. Stores that keep no such times are left as they are.
    """
    now = time.time_ns() // 1_000_000 - len(paths)
    for number, path in enumerate(paths):
        store, place = _hadoop(spark, path)
        for status in store.listStatus(place):
            store.setTimes(status.getPath(), now + number, -1)


def delete_folder(spark: SparkSession, path: str) -> bool:
    store, place = _hadoop(spark, path)
    return store.delete(place, True)


def clear_work(spark: SparkSession) -> bool:
    """Delete all intermediates of this application, once their results are written elsewhere."""
    return delete_folder(spark, _application_dir(spark))
