"""The event log as a stream: each micro-batch names the trips to rebuild (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.schemas import TRIP_EVENTS
from tidemark.operators.merge import upsert
from tidemark.plans.current_state import current_rows, history_of, logical_events
from tidemark.sources.versioned import VersionedTable


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(TRIP_EVENTS).option("maxFilesPerTrigger", max_files).parquet(path)


def without_replays(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """One row per event_id within the watermark. Stream state only saves work: the rebuild reads whole histories."""
    return stream.withColumn("_at", stream["ingested_at"].cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("_at")


def rebuild(table: VersionedTable, log: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What to do with a micro-batch: rebuild its trips from the whole log and commit; a repeated batch changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        trips = batch.select("trip_id").distinct()
        rows = current_rows(logical_events(history_of(log(), trips)))
        table.update(lambda now: upsert(now, rows, ["trip_id"], check=False))

    return run


def maintain(stream: DataFrame, table: VersionedTable, log: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep the current table up to date with a stream of events."""
    return stream.writeStream.foreachBatch(rebuild(table, log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
