"""Reports over an object inventory, the event log and two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import first_group
from tidemark.functions.schemas import MEGABYTE, SMALL_FILE_MB
from tidemark.operators import compare, profiles
from tidemark.operators.latest import BUSINESS_KEY, duplicate_members, regressions_from_previous
from tidemark.plans.event_quality import zero_point

DATE_IN_KEY = r"event_date=(\d{4}-\d{2}-\d{2})"


def with_size_and_date(inventory: DataFrame) -> DataFrame:
    """``size_mb`` (MB = 1024 squared bytes) and the date hidden in the key."""
    return inventory.withColumn("size_mb", F.col("size_bytes") / MEGABYTE).withColumn("event_date", first_group("key", DATE_IN_KEY))


def inventory_report(inventory: DataFrame, thresholds: Sequence[float] = SMALL_FILE_MB) -> dict[str, DataFrame]:
    """Small files, sizes and partitions of an object inventory."""
    rows = with_size_and_date(inventory)
    return {
        "first_rows": profiles.peek(inventory),
        "nulls": profiles.null_profile(inventory),
        "columns": profiles.describe_all(inventory),
        "sizes": profiles.describe(rows, "size_mb"),
        "small_files": profiles.below_thresholds(rows, "size_mb", thresholds),
        "storage_classes": profiles.value_counts(rows, "storage_class", keep_null=True),
        "largest": profiles.largest(rows, "size_mb", "key", 15),
        "smallest": profiles.smallest(rows, "size_mb", "key", 20),
        "files_by_date": profiles.value_counts(rows, "event_date").orderBy("event_date"),
        "partitions": profiles.group_figures(rows, "event_date", "size_mb"),
    }


def late_events(log: DataFrame) -> DataFrame:
    """Events ingested before they happened."""
    return log.filter("ingested_at < event_ts")


def delay_figures(log: DataFrame) -> DataFrame:
    """Seconds from event to ingestion, described."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("event_ts"), F.col("ingested_at")) / 1e6
    return profiles.describe(log.withColumn("delay_seconds", seconds), "delay_seconds")


def midnight_trips(log: DataFrame) -> DataFrame:
    """Trips whose first and last event lie on different days."""
    spans = profiles.spans_by_group(log, "trip_id", "event_ts", "first_event", "last_event")
    return spans.filter(F.col("first_event").cast("date") != F.col("last_event").cast("date"))


def event_report(log: DataFrame, fare_range: tuple[float, float] = (0, 300)) -> dict[str, DataFrame]:
    """Profile and anomaly lists of the event log (C14)."""
    return {
        "first_rows": profiles.peek(log),
        "nulls": profiles.null_profile(log),
        "columns": profiles.describe_all(log),
        "distinct": profiles.distinct_counts(log, ["trip_id"]),
        "repeated_events": profiles.duplicate_count(log, ["event_id"]),
        "repeated_rows": profiles.duplicate_count(log),
        "statuses": profiles.value_counts(log, "status"),
        "events_per_trip": profiles.describe_group_sizes(log, "trip_id"),
        "delay": delay_figures(log),
        "ingested_early": late_events(log),
        "zero_pickups": log.filter(zero_point("pickup_lat", "pickup_lng", either=True)),
        "sequences": profiles.ordered_values(log, "trip_id", ["event_ts", "event_id"], "status"),
        "filled_by_status": profiles.non_null_by_group(log, "status", ["fare_amount", "payment_method", "distance_km", "driver_id"]),
        "duplicate_members": duplicate_members(log, BUSINESS_KEY),
        "odd_fares": log.filter((F.col("fare_amount") < fare_range[0]) | (F.col("fare_amount") > fare_range[1])),
        "regressions": regressions_from_previous(log),
        "midnight": midnight_trips(log),
    }


def snapshot_report(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Keys and values that changed between two snapshots."""
    changes = compare.change_log(before, after, key, columns)
    return {
        "new": compare.new_keys(before, after, key),
        "removed": compare.removed_keys(before, after, key),
        "common": compare.common_keys(before, after, key),
        "changes": changes,
        "by_attribute": profiles.value_counts(changes, "attribute"),
        "totals": changes.agg(F.count_distinct(key).alias("changed_keys"), F.count("*").alias("changes")),
    }
