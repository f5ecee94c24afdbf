"""Keep one row per key in a total order (W1-W3), and comparisons with earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import mapped, status_precedence
from tidemark.functions.schemas import LIFECYCLE_RANK

BUSINESS_KEY = ("trip_id", "status", "event_ts")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; Spark keeps one row per key before the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def drop_replays(log: DataFrame) -> DataFrame:
    """One row per event_id: the last ingested (W1); ties fall to the later event time, then the higher trip and status."""
    return latest_by(log, ["event_id"], [F.desc_nulls_last("ingested_at"), F.desc_nulls_last("event_ts"), F.desc_nulls_last("trip_id"), F.desc_nulls_last("status")])


def drop_business_duplicates(log: DataFrame) -> DataFrame:
    """One row per trip, status and event time: the last ingested, then the higher event_id."""
    return latest_by(log, BUSINESS_KEY, [F.desc_nulls_last("ingested_at"), F.desc_nulls_last("event_id")])


def event_order() -> list[Column]:
    """Event time, event_id; replays of one event go by ingestion time, then by status."""
    return [F.asc_nulls_last(c) for c in ("event_ts", "event_id", "ingested_at", "status")]


def regressions_from_highest(log: DataFrame) -> DataFrame:
    """Events whose precedence lies below the highest one before them in their trip."""
    before = Window.partitionBy("trip_id").orderBy(*event_order()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = log.withColumn("status_precedence", status_precedence())
    return ranked.withColumn("highest_before", F.max("status_precedence").over(before)).filter("status_precedence < highest_before")


def regressions_from_previous(log: DataFrame) -> DataFrame:
    """Events whose lifecycle rank lies below that of the event just before."""
    ranked = log.withColumn("status_rank", mapped("status", LIFECYCLE_RANK))
    order = Window.partitionBy("trip_id").orderBy(*event_order())
    return ranked.withColumn("previous_rank", F.lag("status_rank", 1).over(order)).filter("status_rank < previous_rank")


def duplicate_groups(log: DataFrame, keys: Sequence[str] = BUSINESS_KEY) -> DataFrame:
    """Keys that occur more than once, with their number of rows (A3)."""
    return log.groupBy(*keys).agg(F.count("*").alias("rows_in_group")).filter("rows_in_group > 1")


def duplicate_members(log: DataFrame, keys: Sequence[str] = BUSINESS_KEY) -> DataFrame:
    """All rows of keys that occur more than once."""
    return log.withColumn("rows_in_group", F.count("*").over(Window.partitionBy(*keys))).filter("rows_in_group > 1")
