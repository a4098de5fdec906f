"""The incremental state on disk: a key index that is probed without touching payloads.

Rows lie in a Parquet table bucketed by the hash of the path, so neither the choice of the newest row
of a path nor a probe shuffles the state: only the files to look up move, to the bucket of their path.
Keys, validity and payload size are columns of their own, and the payload is not read unless asked for.
Files of the table are sorted by the rows' mtime, so payloads of known times are found by Parquet's indexes.
Whether a payload can be parsed is judged once, when it is written.

``commits`` says which writes count: each write marks its rows, and rows of a write that was not
committed are never seen, so a write that failed half-way may be repeated. A batch that was applied
already is skipped. A snapshot starts a new folder, later writes are added to it, and ``vacuum``
deletes the folders before it. One writer at a time; readers need no lock.

Bucketed tables need a catalog entry: a table called ``arborlake_state_...`` is made in the session's
current database for each folder that is opened, without data of its own; ``vacuum`` drops the old ones.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake.functions.jsontext import strict_json
from arborlake.operators.cache import last_wins, probe_keys, rows_to_keep, within
from arborlake.operators.ordering import newest_rows
from arborlake.options import CACHE_LIMIT_MIB, MIB
from arborlake.schema import CACHE
from arborlake.session import delete_folder, folders, materialise

BUCKETS = 64
_COMMITS = "number BIGINT, kind STRING, batch STRING, mark STRING, buckets INT"
KEYS = ("path", "file_hash", "size", "mtime_us", "valid", "bytes", "mark")
_COLUMNS = ("path STRING, file_hash STRING, size BIGINT, mtime_us BIGINT, valid BOOLEAN, bytes BIGINT, "
            "number BIGINT, mark STRING, file_info STRING")


class CacheTable:
    """State of ``schema.CACHE`` rows, keyed by full path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets

    # ---- commits

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], _COMMITS)

    def _heads(self, batch: str = "") -> tuple[int, int, int, bool]:
        """Number and buckets of the last snapshot, number of the last write, whether ``batch`` was applied."""
        base, last, applied = self._commits().agg(
            F.max(F.when(F.col("kind") == "snapshot", F.struct("number", "buckets"))),
            F.max("number"), F.max(F.col("batch") == batch)).first()
        return *(base or (0, self.buckets)), last or 0, bool(applied)

    def _live(self) -> list:
        """The last snapshot and the writes after it, oldest first; upkeep keeps this list short."""
        base = self._heads()[0]
        return sorted(self._commits().filter(F.col("number") >= base).collect(), key=lambda row: row["number"])

    def applied(self, batch: str) -> bool:
        return not self._commits().filter(F.col("batch") == batch).isEmpty()

    def _name(self, base: int) -> str:
        return f"arborlake_state_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{base}"

    def _folder(self, base: int, buckets: int) -> str:
        """The catalog's name of the folder of a snapshot; the entry is made where it is missing."""
        place = f"{self.path}/base={base}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(base)} ({_COLUMNS}) USING parquet "
            f"CLUSTERED BY (path) SORTED BY (mtime_us) INTO {buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(self._name(base))
        return self._name(base)

    def _commit(self, rows: DataFrame, kind: str, batch: str) -> bool:
        base, buckets, last, applied = self._heads(batch)
        if applied:
            return False
        number = last + 1
        starts = kind == "snapshot" or not last
        if starts:
            base, buckets = number, self.buckets
        mark = uuid.uuid4().hex
        rows.select(
            "path", "file_hash", F.col("size").cast("long"), F.col("mtime_us").cast("long"),
            F.coalesce(strict_json(F.col("file_info")).isNotNull(), F.lit(False)),
            F.octet_length("file_info").cast("long"), F.lit(number).cast("long"), F.lit(mark), "file_info",
        ).repartition(buckets, "path").write.insertInto(self._folder(base, buckets))
        self.spark.createDataFrame(
            [(number, "snapshot" if starts else kind, batch, mark, buckets)], _COMMITS
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def upsert(self, changes: DataFrame, batch: str) -> bool:
        """Add rows (unique per path); False when the batch was applied before."""
        return self._commit(changes, "delta", batch)

    def replace(self, rows: DataFrame, batch: str) -> bool:
        """New snapshot, for example after removing orphans, eviction or compaction."""
        return self._commit(rows, "snapshot", batch)

    # ---- reading

    def _rows(self, live: list | None = None) -> DataFrame:
        """All committed rows, older ones of a path too; of the writes ``live`` if they are known."""
        live = self._live() if live is None else live
        if not live:
            return self.spark.createDataFrame([], _COLUMNS)
        table = self.spark.table(self._folder(live[0]["number"], live[0]["buckets"]))
        return table.filter(F.col("mark").isin([row["mark"] for row in live]))

    def keys(self, live: list | None = None) -> DataFrame:
        """``KEYS`` of the newest row of each path; payloads are not read."""
        keys = self._rows(live).select(*KEYS, "number")
        return last_wins(keys, "path", F.col("number").desc()).drop("number")

    def with_payloads(self, rows: DataFrame, path: str = "path", live: list | None = None,
                      mtimes: list[tuple[int, int]] | None = None) -> DataFrame:
        """``file_info`` for rows that carry a stored path in column ``path`` and its ``mark``.

        Where all of them were stored with an mtime in the ranges ``mtimes``, other payloads are not read.

        The state is bucketed by path alone, so the mark is compared by two inequalities: as an
        equality it would become a join key, and the payloads would be shuffled by both.
        """
        stored = self._rows(live)
        if mtimes is not None:
            stored = stored.filter(within(F.col("mtime_us"), mtimes))
        stored = stored.select(
            F.col("path").alias("_stored"), F.col("mark").alias("_write"), "file_info")
        same = (F.col(path) == F.col("_stored")) & (F.col("mark") <= F.col("_write")) & (
            F.col("mark") >= F.col("_write"))
        return rows.join(stored, same).drop("_stored", "_write")

    def read(self) -> DataFrame:
        """Current rows of ``schema.CACHE``."""
        columns = [c.split(" ")[0] for c in CACHE.split(", ")]
        return self.with_payloads(self.keys()).select(*columns)

    def below(self, root: str, mtimes: list[tuple[int, int]] | None = None) -> RootedCache:
        """The state of one tree, whose files have paths relative to ``root``.

        ``mtimes`` may give ranges that hold every mtime it is probed with (``operators.cache.spans``).
        """
        return RootedCache(self, root, mtimes)

    # ---- upkeep

    def accounting(self) -> tuple[int, int]:
        """Rows and payload bytes, from the keys alone."""
        return tuple(self.keys().agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first())

    def remove_orphans(self, files: DataFrame, root: str, batch: str) -> bool:
        """Drop stored paths below ``root`` that are not in ``files``; a new snapshot if there are any."""
        lead = _lead(root)
        there = files.select(F.concat(F.lit(lead), "path").alias("path"))
        keys = self.keys()
        gone = keys.filter(F.startswith("path", F.lit(lead))).join(there, "path", "left_anti")
        if gone.isEmpty():
            return False
        return self.replace(self.with_payloads(keys.join(gone.select("path"), "path", "left_anti")), batch)

    def evict(self, batch: str, limit_bytes: int = CACHE_LIMIT_MIB * MIB) -> bool:
        """Keep the newest rows by mtime once the payloads are over the limit."""
        rows, size = self.accounting()
        keep = rows_to_keep(rows, size, limit_bytes)
        if keep == rows:
            return False
        keys = materialise(self.keys(), "state-keys")
        newest = newest_rows(keys.select("mtime_us", "path"), keep).select("path")
        return self.replace(self.with_payloads(keys.join(newest, "path", "left_semi")), batch)

    def compact_beyond(self, writes: int, batch: str, doubled: bool = False) -> bool:
        """New snapshot once more than ``writes`` of them have to be merged to read the state.

        With ``doubled`` only if the writes after the last snapshot have as many rows as it, looked up once
        in ``writes`` of them: all snapshots together then stay in proportion to the rows written.
        """
        base, _, last, _ = self._heads()
        if last - base + bool(last) <= writes:  # numbers have no gaps
            return False
        if doubled:
            if (last - base) % max(writes, 1):
                return False
            live = self._live()
            old = F.col("mark") == live[0]["mark"]
            before, after = self._rows(live).agg(F.count_if(old), F.count_if(~old)).first()
            if after < before:
                return False
        return self.replace(self.read(), batch)

    def vacuum(self) -> int:
        """Delete the folders before the last snapshot and say how many.

        Frames read from the state before that snapshot can no longer be computed.
        """
        live = self._live()
        old = [name for name in folders(self.spark, self.path)
               if live and name.startswith("base=") and int(name[len("base="):]) < live[0]["number"]]
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(int(name[len('base='):]))}")
            delete_folder(self.spark, f"{self.path}/{name}")
        return len(old)

    def upkeep(self, files: DataFrame | None, root: str, batch: str, *, limit_bytes: int = CACHE_LIMIT_MIB * MIB,
               writes: int = 20) -> list[str]:
        """Upkeep after a run over ``root``; names what was done. Without ``files`` orphans stay."""
        done = []
        if files is not None and self.remove_orphans(files, root, f"{batch}:orphans"):
            done.append("orphans")
        if self.evict(f"{batch}:evict", limit_bytes):
            done.append("evict")
        if self.compact_beyond(writes, f"{batch}:compact"):
            done.append("compact")
        if self.vacuum():
            done.append("vacuum")
        return done


def _lead(root: str) -> str:
    return root.rstrip("/") + "/" if root else ""


class RootedCache:
    """Probes with relative paths. Several trees share a table, as stored paths are full ones.

    All probes see the writes that were there at the first one, or at the last ``upsert`` from here.
    """

    def __init__(self, table: CacheTable, root: str, mtimes: list[tuple[int, int]] | None = None):
        self.table, self.root, self.mtimes = table, root, mtimes
        self._live: list | None = None

    def _writes(self) -> list:
        if self._live is None:
            self._live = self.table._live()
        return self._live

    def _probed(self, files: DataFrame, validate: str, how: str, *columns: Column) -> DataFrame:
        keys = self.table.keys(self._writes()).filter("valid").select(
            *[F.col(k).alias(f"_{k}") for k in probe_keys(validate)], *columns)
        moved = files.withColumn("_full", F.concat(F.lit(_lead(self.root)), "path"))
        same = F.col("_full") == F.col("_path")
        for key in probe_keys(validate)[1:]:
            # not a join key, or the state would be shuffled by it: see with_payloads
            same &= (F.col(key) <= F.col(f"_{key}")) & (F.col(key) >= F.col(f"_{key}"))
        return moved.join(keys, same, how)

    def hits(self, files: DataFrame, validate: str = "stat") -> DataFrame:
        """Files with a valid stored result for the same size and mtime, and that result."""
        stored = [c for c in ("file_hash",) if c not in files.columns]
        found = self._probed(files, validate, "inner", F.col("mark"), *[F.col(c) for c in stored])
        return self.table.with_payloads(found, "_full", self._writes(), self.mtimes).select(
            *files.columns, *stored, "file_info")

    def misses(self, files: DataFrame, validate: str = "stat") -> DataFrame:
        """Files to process: unknown, changed, or with an unreadable stored result."""
        return self._probed(files, validate, "left_anti").drop("_full")

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Add rows whose paths are relative to the root."""
        self._live = None
        return self.table.upsert(rows.withColumn("path", F.concat(F.lit(_lead(self.root)), "path")), batch)
