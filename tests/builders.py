"""Small tables for scenario tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tidemark.functions.schemas import DRIVER_SNAPSHOT, TRIP_EVENTS


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(f"2026-05-{text}:00")


def log(spark, *events):
    """(event_id, trip_id, status, event_ts[, changes]) -> an event log; ingested five minutes after by default."""
    rows = []
    for event_id, trip_id, status, ts, *more in events:
        row = dict.fromkeys(TRIP_EVENTS.names)
        row |= {"event_id": event_id, "trip_id": trip_id, "rider_id": 1, "driver_id": 3001, "city_id": 34, "status": status, "fare_amount": Decimal("10.00"), "surge_multiplier": Decimal("1.00")}
        row |= {"pickup_lat": Decimal("41"), "pickup_lng": Decimal("29"), "vehicle_type": "economy", "event_ts": at(ts), "ingested_at": at(ts) + dt.timedelta(minutes=5)}
        row |= more[0] if more else {}
        rows.append(tuple(row[c] for c in TRIP_EVENTS.names))
    return spark.createDataFrame(rows, TRIP_EVENTS)


def snapshot(spark, day: int, *drivers):
    """(driver_id, name, city, vehicle, rating, status) -> a snapshot of a day of May 2026."""
    rows = [(i, n, c, v, Decimal(r), s, dt.date(2026, 5, day)) for i, n, c, v, r, s in drivers]
    return spark.createDataFrame(rows, DRIVER_SNAPSHOT)
