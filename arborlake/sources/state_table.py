"""A keyed state table as versioned Parquet: deltas appended per batch, snapshots on upkeep.

``data/version=N`` holds the rows of commit N and ``commits`` says which versions count, so a
write that failed half-way is never read. A batch that was applied already is skipped, which
makes ``foreachBatch`` exactly-once. One writer at a time; readers need no lock.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlake.operators.cache import last_wins
from arborlake.session import delete_folder, folders

_COMMITS = "version BIGINT, kind STRING, batch STRING"


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.key = key

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], _COMMITS)

    def _live_versions(self) -> list[int]:
        """Last snapshot and the deltas after it; upkeep keeps this list short."""
        commits = self._commits()
        base = commits.agg(F.max(F.when(F.col("kind") == "snapshot", F.col("version")))).first()[0]
        live = commits.filter(F.col("version") >= (base if base is not None else 0))
        return [row[0] for row in live.select("version").orderBy("version").collect()]

    def _next_version(self) -> int:
        return (self._commits().agg(F.max("version")).first()[0] or 0) + 1

    def applied(self, batch: str) -> bool:
        return not self._commits().filter(F.col("batch") == batch).isEmpty()

    def read(self) -> DataFrame:
        """Current rows: of every key the one from the latest version."""
        versions = self._live_versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.path}/data"
        rows = (
            self.spark.read.schema(self.schema + ", version BIGINT")
            .option("basePath", data)
            .parquet(*[f"{data}/version={v}" for v in versions])
        )
        if len(versions) == 1:
            return rows.drop("version")
        return last_wins(rows, self.key, F.col("version").desc()).drop("version")

    def _commit(self, rows: DataFrame, kind: str, batch: str) -> int:
        version = self._next_version()
        rows.write.mode("overwrite").parquet(f"{self.path}/data/version={version}")
        self.spark.createDataFrame([(version, kind, batch)], _COMMITS).coalesce(1).write.mode(
            "append").parquet(f"{self.path}/commits")
        return version

    def upsert(self, changes: DataFrame, batch: str) -> bool:
        """Append one delta (unique per key); False when the batch was applied before."""
        if self.applied(batch):
            return False
        self._commit(changes, "delta", batch)
        return True

    def replace(self, rows: DataFrame, batch: str) -> bool:
        """New snapshot, for example after removing orphans, eviction or compaction."""
        if self.applied(batch):
            return False
        self._commit(rows, "snapshot", batch)
        return True

    def compact(self, batch: str, partitions: int | None = None) -> int:
        """Fold the deltas into a snapshot and return its size in bytes."""
        rows = self.read()
        self.replace(rows if partitions is None else rows.repartition(partitions), batch)
        return self.bytes_on_disk()

    def compact_beyond(self, versions: int, batch: str) -> bool:
        """Compact once more than ``versions`` of them have to be merged to read the table."""
        if len(self._live_versions()) <= versions:
            return False
        return self.replace(self.read(), batch)

    def vacuum(self) -> int:
        """Delete the versions that the last snapshot replaced, and say how many.

        Frames read from the table before that snapshot can no longer be computed.
        """
        live = self._live_versions()
        data = f"{self.path}/data"
        old = [f"{data}/{name}" for name in folders(self.spark, data)
               if live and name.startswith("version=") and int(name[len("version="):]) < live[0]]
        for path in old:
            delete_folder(self.spark, path)
        return len(old)

    def bytes_on_disk(self) -> int:
        """Bytes of the live versions, from the listing alone."""
        paths = [f"{self.path}/data/version={v}" for v in self._live_versions()]
        if not paths:
            return 0
        listed = self.spark.read.format("binaryFile").load(paths)
        return listed.agg(F.sum("length")).first()[0] or 0
