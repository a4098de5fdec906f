"""Log streams: routing by level and a rolling buffer per logger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators.logs import IMMEDIATE_LEVEL, buffered
from arborlake.options import LOG_BUFFER_ROWS
from arborlake.sources.state_table import StateTable

BATCH_INTERVAL = "100 milliseconds"


def split(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors and worse, to deliver at once; and the rest. Every row is in exactly one."""
    urgent = F.col("level") >= IMMEDIATE_LEVEL
    return stream.filter(urgent), stream.filter(~urgent)


def route(
    stream: DataFrame, urgent_path: str, batch_path: str, checkpoint: str,
    *, urgent_trigger: dict | None = None, batch_trigger: dict | None = None,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Two sinks with their own triggers: errors as they come, the others in batches."""
    urgent, rest = split(stream)
    now = urgent_trigger or {"processingTime": "0 seconds"}
    later = batch_trigger or {"processingTime": BATCH_INTERVAL}
    return (
        urgent.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/urgent")
        .trigger(**now).start(urgent_path),
        rest.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/batched")
        .trigger(**later).start(batch_path),
    )


def rolling_buffer(
    stream: DataFrame, state: StateTable, checkpoint: str, n: int = LOG_BUFFER_ROWS,
    *, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the last ``n`` rows per logger in ``state``.

    Each batch is merged with the buffer by the salted two-round selection, so a logger with a
    third of all rows is not handled by one task, as keyed streaming state would do. The snapshot
    that a batch replaces is deleted.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        held = state.read()
        merged = held.unionByName(batch.select(*held.columns))
        state.replace(buffered(merged, n), f"{checkpoint}:{batch_id}")
        state.vacuum()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(run)
        .start()
    )
