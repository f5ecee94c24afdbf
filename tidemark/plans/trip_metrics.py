"""Milestones and durations of each trip."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import on_days, seconds_between
from tidemark.operators.latest import drop_business_duplicates

COLUMNS = (
    "trip_id", "rider_id", "driver_id", "city_id", "vehicle_type", "trip_date",
    "requested_at", "driver_assigned_at", "picked_up_at", "completed_at",
    "time_to_assign_seconds", "wait_to_pickup_seconds", "trip_duration_seconds", "total_trip_lifecycle_seconds",
    "fare_amount", "distance_km", "surge_multiplier", "payment_method", "lifecycle_status",
)


def milestones(events: DataFrame) -> DataFrame:
    """One row per trip, from one aggregation.

    First and last values go by event time, then event id, so that ties always
    fall the same way.
    """
    at = F.struct("event_ts", "event_id")
    done = F.col("status") == "completed"

    def first_time(status: str) -> Column:
        return F.min(F.when(F.col("status") == status, F.col("event_ts"))).alias("completed_at" if status == "completed" else f"{status}_at")

    return events.groupBy("trip_id").agg(
        F.min_by("rider_id", at).alias("rider_id"),
        F.max_by("driver_id", F.when(F.col("driver_id").isNotNull(), at)).alias("driver_id"),
        F.min_by("city_id", at).alias("city_id"),
        F.min_by("vehicle_type", at).alias("vehicle_type"),
        *(first_time(s) for s in ("requested", "driver_assigned", "picked_up", "completed")),
        *(F.max_by(c, F.when(done, at)).alias(c) for c in ("fare_amount", "distance_km", "payment_method")),
        F.max("surge_multiplier").alias("surge_multiplier"),
    )


def lifecycle_status() -> Column:
    """The furthest milestone reached (P13); cancelled trips show the last one before."""
    return (
        F.when(F.col("completed_at").isNotNull(), "completed")
        .when(F.col("picked_up_at").isNotNull(), "picked_up")
        .when(F.col("driver_assigned_at").isNotNull(), "driver_assigned")
        .otherwise("requested")
    )


def with_durations(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("trip_date", F.col("requested_at").cast("date"))
        .withColumn("time_to_assign_seconds", seconds_between("requested_at", "driver_assigned_at"))
        .withColumn("wait_to_pickup_seconds", seconds_between("driver_assigned_at", "picked_up_at"))
        .withColumn("trip_duration_seconds", seconds_between("picked_up_at", "completed_at"))
        .withColumn("total_trip_lifecycle_seconds", seconds_between("requested_at", "completed_at"))
        .withColumn("lifecycle_status", lifecycle_status())
    )


def trip_metrics(log: DataFrame, trip_date: dt.date | None = None) -> DataFrame:
    """Metrics of the trips requested on a date, in trip order; all trips without a date.

    Only trips with a request on that date are aggregated; those first requested
    before it go afterwards.
    """
    if trip_date is not None:
        that_day = log.filter((F.col("status") == "requested") & on_days("event_ts", trip_date, trip_date)).select("trip_id").distinct()
        log = log.join(that_day, "trip_id", "left_semi")
    rows = with_durations(milestones(drop_business_duplicates(log)))
    if trip_date is not None:
        rows = rows.filter(F.col("trip_date") == F.lit(trip_date))
    return rows.select(*COLUMNS).orderBy(F.asc_nulls_last("trip_id"))
