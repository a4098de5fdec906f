"""``spark.read.format("filetree")``: files below a directory with their stat values.

Spark's own file listing leaves out names that start with ``_`` or ``.``; this source does not.
The root must be mounted on every executor. Only metadata is read here; see ``content``.

Options: ``path``; ``excludedFolders`` and ``excludePatterns`` (JSON lists, pruned before they
are entered); ``changedAfterUs`` and ``changedUntilUs`` (inode change times); ``followSymlinks``; ``partitions`` (directories to plan for) and ``splits``
(tasks that share the stat calls of the same directories, for directories with very many files).
"""

from __future__ import annotations

import fnmatch
import json
import logging
import os
import re
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)

from arborlake.functions.patterns import translated
from arborlake.options import ScanOptions
from arborlake.schema import FILES
from arborlake.session import materialise

log = logging.getLogger(__name__)

SCHEMA = FILES + ", location STRING, real_dir STRING"
_ROWS_PER_BATCH = 10_000
_PLANNED_PER_PARTITION = 10  # directories the planner lists at most, per wanted partition


@dataclass
class _Share(InputPartition):
    """Directories for one task: walked down to the leaves, and listed for their own files only."""

    walked: tuple[str, ...]
    listed: tuple[str, ...]
    split: int
    splits: int
    after_us: int | None = None
    until_us: int | None = None


class _Walker:
    """Directory listing with pruning, shared by planner and tasks."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.folders = frozenset(json.loads(options.get("excludedfolders", "[]")))
        self.follow = str(options.get("followsymlinks", "false")).lower() == "true"
        self.rules = []
        for rule in json.loads(options.get("excludepatterns", "[]")):
            expression = rule[6:] if rule.startswith("regex:") else fnmatch.translate(rule)
            # what the column rules cannot express is ignored here as well
            if not rule.startswith("regex:") or translated(expression) is not None:
                self.rules.append(re.compile(expression))

    def _pruned(self, name: str) -> bool:
        return name in self.folders or any(rule.match(name) for rule in self.rules)

    def listing(self, directory: str) -> Iterator[tuple[bool, os.DirEntry]]:
        """Directories to enter (true) and files, one by one, so that a very full directory is
        never held; an unreadable directory gives neither."""
        try:
            with os.scandir(directory) as found:
                for entry in found:
                    if entry.is_dir():
                        enter = self.follow or not entry.is_symlink()
                        if enter and not self._pruned(entry.name):
                            yield True, entry
                    elif entry.is_file():
                        yield False, entry
        except OSError as problem:
            log.warning("skipping directory %s: %s", directory, problem)

    def rows(self, share: _Share) -> Iterator[tuple]:
        for directory in share.listed:
            for is_dir, row in self.level(directory, share):
                if not is_dir:
                    yield row
        for top in share.walked:
            stack, seen = [top], set()
            while stack:
                directory = stack.pop()
                if self.follow:
                    real = os.path.realpath(directory)
                    if real in seen:
                        continue
                    seen.add(real)
                for is_dir, found in self.level(directory, share):
                    if is_dir:
                        stack.append(found)
                    else:
                        yield found

    def level(self, directory: str, share: _Share) -> Iterator[tuple]:
        """Paths of the directories below (with true) and rows of the files of the share."""
        real = os.path.realpath(directory)
        parent = os.path.relpath(directory, self.root)
        parent = "" if parent == "." else parent.replace(os.sep, "/")
        for is_dir, entry in self.listing(directory):
            if is_dir:
                yield True, entry.path
                continue
            if share.splits > 1 and zlib.crc32(os.fsencode(entry.name)) % share.splits != share.split:
                continue
            row = self._row(entry, parent, real, share)
            if row is not None:
                yield False, row

    def _row(self, entry: os.DirEntry, parent: str, real: str, share: _Share) -> tuple | None:
        path = f"{parent}/{entry.name}" if parent else entry.name
        try:
            stat = entry.stat()
        except OSError as problem:
            error = f"{type(problem).__name__}: {problem}"
            return (path, parent, entry.name, None, None, None, None, error, entry.path, real)
        if share.until_us is not None:
            changed = stat.st_ctime_ns // 1000
            if not share.after_us < changed <= share.until_us:
                return None
        born = getattr(stat, "st_birthtime", None)
        return (
            path, parent, entry.name, stat.st_size, stat.st_mtime_ns // 1000,
            None if born is None else int(born * 1_000_000), stat.st_mode, None, entry.path, real,
        )


def _plan(walker: _Walker, options: dict, **window) -> list[_Share]:
    """Widen from the root until there are enough directories to hand out.

    The planner lists a bounded number of directories; everything below is listed in tasks, of
    which there are at most ``partitions`` (or ``splits``, if that is more) however wide the tree.
    """
    wanted = int(options.get("partitions", 64))
    splits = int(options.get("splits", 1))
    frontier = deque([walker.root])
    listed: list[str] = []
    entered = set()
    while frontier and len(frontier) < wanted and len(listed) < wanted * _PLANNED_PER_PARTITION:
        directory = frontier.popleft()
        real = os.path.realpath(directory)
        if walker.follow and real in entered:
            continue
        entered.add(real)
        listed.append(directory)
        frontier.extend(entry.path for is_dir, entry in walker.listing(directory) if is_dir)
    walked = list(frontier)
    bundles = max(1, min(wanted // splits, max(len(walked), len(listed))))
    return [
        _Share(tuple(walked[i::bundles]), tuple(listed[i::bundles]), split, splits, **window)
        for i in range(bundles)
        for split in range(splits)
    ]


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        until = self.options.get("changeduntilus")
        window = {} if until is None else {
            "after_us": int(self.options.get("changedafterus", -1)), "until_us": int(until)}
        return _plan(_Walker(self.options), self.options, **window)

    def read(self, partition):
        return _Walker(self.options).rows(partition)


class FileTreeStreamReader(DataSourceStreamReader):
    """New and changed files by inode change time, which copying cannot set back.

    A batch covers the times up to ``settleSeconds`` (default 2) before now, so that a file still
    being written is left to a later batch. ``maxWindowSeconds`` bounds the time a batch spans
    while the query runs; the first batch after a start takes everything up to now. For batches of
    bounded size, whatever the tree holds, see ``sources.listing``.
    Time always moves on, so every trigger lists the tree once, also when nothing changed: run it
    with ``availableNow`` or a ``processingTime`` that suits the size of the tree.
    """

    def __init__(self, options: dict):
        self.options = options
        self.settle_us = int(float(options.get("settleseconds", 2)) * 1_000_000)
        self.window_us = int(float(options.get("maxwindowseconds", 0)) * 1_000_000)
        self._last_us = 0

    def initialOffset(self):
        return {"until_us": 0}

    def latestOffset(self):
        now = time.time_ns() // 1000 - self.settle_us
        if self.window_us and self._last_us:
            now = min(now, self._last_us + self.window_us)
        return {"until_us": now}

    def partitions(self, start, end):
        self._last_us = end["until_us"]
        return _plan(
            _Walker(self.options), self.options,
            after_us=start["until_us"], until_us=end["until_us"],
        )

    def commit(self, end):
        self._last_us = end["until_us"]

    def read(self, partition):
        return _Walker(self.options).rows(partition)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self._plain_options())

    def streamReader(self, schema):
        return FileTreeStreamReader(self._plain_options())

    def _plain_options(self) -> dict:
        """Option names are case-insensitive to the user; tasks get them in lower case."""
        return {name.lower(): value for name, value in self.options.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTreeSource)


def _source_options(root: str, options: ScanOptions) -> dict[str, str]:
    return {
        "path": root,
        "excludedFolders": json.dumps(list(options.excluded_folders)),
        "excludePatterns": json.dumps(list(options.exclude_patterns)),
        "followSymlinks": str(options.follow_symlinks).lower(),
    }


def scan(spark: SparkSession, root: str, options: ScanOptions, **extra) -> DataFrame:
    """Files below ``root``. With links followed, a directory reached on several ways counts once
    (the way that sorts first)."""
    register(spark)
    extra.setdefault("partitions", _parallelism(spark))
    reader = spark.read.format("filetree").options(**_source_options(root, options), **extra)
    files = reader.load()
    if not options.follow_symlinks:
        return files
    others = [c for c in files.columns if c not in ("real_dir", "filename")]
    first = files.groupBy("real_dir", "filename").agg(
        F.min_by(F.struct(*others), F.col("path")).alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) if c in others else F.col(c)
                          for c in files.columns])


def _parallelism(spark: SparkSession) -> int:
    return max(64, 4 * spark.sparkContext.defaultParallelism)


LEVEL_SCHEMA = SCHEMA + ", is_dir BOOLEAN"


def _level_lister(options: dict):
    def list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = _Walker(options)
        names = [column.split(" ")[0] for column in LEVEL_SCHEMA.split(", ")]
        rows = []
        whole = _Share((), (), 0, 1)
        for batch in batches:
            for directory in batch["directory"]:
                for is_dir, found in walker.level(directory, whole):
                    rows.append((None,) * 8 + (found, os.path.realpath(found), True) if is_dir
                                else (*found, False))
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=names, dtype="object")
                        rows = []
        yield pd.DataFrame(rows, columns=names, dtype="object")
    return list_level


def scan_levels(
    spark: SparkSession, root: str, options: ScanOptions, partitions: int | None = None
) -> DataFrame:
    """``scan`` for trees whose files sit unevenly: one job per depth.

    The directories found on one level are spread anew over all tasks for the next, so a
    subtree with most of the files is not listed by one task. Levels are written out once.
    With links followed, a directory is entered once, whichever ways lead to it.
    """
    plain = {name.lower(): value for name, value in _source_options(root, options).items()}
    lister = _level_lister(plain)
    wanted = partitions or _parallelism(spark)
    top = os.path.abspath(root)
    frontier = spark.createDataFrame([(top,)], "directory STRING")
    seen = spark.createDataFrame([(os.path.realpath(top),)], "real_dir STRING")
    files = None
    while True:
        level = materialise(
            frontier.repartition(wanted).mapInPandas(lister, LEVEL_SCHEMA), "level")
        found = level.filter("NOT is_dir").drop("is_dir")
        files = found if files is None else files.unionByName(found)
        directories = level.filter("is_dir")
        if options.follow_symlinks:
            directories = directories.groupBy("real_dir").agg(
                F.min("location").alias("location")).join(seen, "real_dir", "left_anti")
            seen = seen.unionByName(directories.select("real_dir"))
        frontier = directories.select(F.col("location").alias("directory"))
        if frontier.isEmpty():
            return files


def scan_stream(spark: SparkSession, root: str, options: ScanOptions, **extra) -> DataFrame:
    register(spark)
    return spark.readStream.format("filetree").options(
        **_source_options(root, options), **extra).load()
