"""Incremental reads of an append-only log with Structured Streaming.

The stream's checkpoint is the cursor: each call processes the files that arrived since the
last one and stops. Changed files are not read again by a file stream, which is right for a
log that only grows; sources that are rewritten go through ``stale_sources`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.event_log import latest_outputs
from millrace.sources.tables import Warehouse


def follow_log(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    *,
    pattern: str = "*.parquet",
    after_id: int | None = None,
    id_column: str = "id",
    files_per_batch: int = 1000,
) -> DataFrame:
    """The log as a stream, optionally only ids after a cursor."""
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )
    return rows if after_id is None else rows.where(F.col(id_column) > after_id)


def drain(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything new to parquet at ``target``, exactly once, and stop."""
    (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
        .awaitTermination()
    )


def drain_each(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Hand everything new to ``handle(rows, batch_id)`` and stop."""
    (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def refresh_outputs(warehouse: Warehouse, table: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that merges new step rows into the table of newest outputs.

    Handling the same batch twice gives the same table: the highest id wins.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        known = warehouse.frame(table) if warehouse.exists(table) else None
        warehouse.write(table, latest_outputs(rows, known=known))

    return handle
