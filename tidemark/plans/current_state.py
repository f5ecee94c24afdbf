"""Incremental rebuild of one current row per trip from the event log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import on_days, status_precedence
from tidemark.functions.schemas import CURRENT_TRIPS, LOOKBACK_DAYS
from tidemark.operators.latest import drop_business_duplicates, drop_replays
from tidemark.operators.merge import upsert


def affected_trips(log: DataFrame, processing_date: dt.date, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Trips with an event ingested from ``lookback_days`` before the date to the date, both included."""
    first = processing_date - dt.timedelta(days=lookback_days)
    return log.filter(on_days("ingested_at", first, processing_date)).select("trip_id").distinct()


def history_of(log: DataFrame, trips: DataFrame) -> DataFrame:
    """All events of those trips, whatever their time (C2); a semi-join, which needs no distinct ids."""
    return log.join(trips.select("trip_id"), "trip_id", "left_semi")


def logical_events(log: DataFrame) -> DataFrame:
    """Replays dropped, then business duplicates."""
    return drop_business_duplicates(drop_replays(log))


def current_rows(events: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One row per trip: the event of highest precedence, then latest time, then highest id (C4).

    The trip date, the day of the first request, comes from a window over the same
    trips, so one shuffle serves both. ``as_of`` leaves out later events.
    """
    rows = events if as_of is None else events.filter(F.col("event_ts") < F.lit(as_of + dt.timedelta(days=1)))
    trip = Window.partitionBy("trip_id")
    rows = rows.withColumn("_requested", F.min(F.when(F.col("status") == "requested", F.col("event_ts"))).over(trip)).withColumn("_precedence", status_precedence())
    order = trip.orderBy(F.desc("_precedence"), F.desc_nulls_last("event_ts"), F.desc_nulls_last("event_id"))
    best = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    renamed = {"current_status": "status", "latest_event_id": "event_id", "latest_event_ts": "event_ts", "last_ingested_at": "ingested_at"}
    return best.select(*(F.col("_requested").cast("date").alias(c) if c == "trip_date" else F.col(renamed.get(c, c)).alias(c) for c in CURRENT_TRIPS.names))


def build_current(log: DataFrame, processing_date: dt.date, lookback_days: int = LOOKBACK_DAYS, as_of: dt.date | None = None) -> DataFrame:
    """Rows to merge for a processing date: C1 to C4."""
    return current_rows(logical_events(history_of(log, affected_trips(log, processing_date, lookback_days))), as_of)


def apply_current(target: DataFrame, log: DataFrame, processing_date: dt.date, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """The next current table (C5); applying it twice changes nothing more."""
    return upsert(target, build_current(log, processing_date, lookback_days), ["trip_id"], check=False)  # one row per trip by construction
