"""Schemas and domain constants of the event log, the snapshots and the maintained tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

_L, _I, _S, _D, _N, _B = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_PLACE = T.DecimalType(9, 6)

TRIP_EVENTS = _schema(
    event_id=_L, trip_id=_L, rider_id=_L, driver_id=_L, city_id=_I, status=_S,
    fare_amount=T.DecimalType(10, 2), surge_multiplier=T.DecimalType(3, 2), distance_km=T.DecimalType(8, 2),
    pickup_lat=_PLACE, pickup_lng=_PLACE, dropoff_lat=_PLACE, dropoff_lng=_PLACE,
    vehicle_type=_S, promo_code_id=_L, event_ts=_N, ingested_at=_N, payment_method=_S,
)

DRIVER_SNAPSHOT = _schema(driver_id=_L, driver_name=_S, city_id=_I, vehicle_type=_S, rating=T.DecimalType(3, 2), driver_status=_S, snapshot_date=_D)

OBJECT_INVENTORY = _schema(key=_S, size_bytes=_L, storage_class=_S, last_modified=_N)

CURRENT_TRIPS = _schema(
    trip_id=_L, rider_id=_L, driver_id=_L, city_id=_I, current_status=_S,
    fare_amount=T.DecimalType(10, 2), surge_multiplier=T.DecimalType(3, 2), distance_km=T.DecimalType(8, 2),
    pickup_lat=_PLACE, pickup_lng=_PLACE, dropoff_lat=_PLACE, dropoff_lng=_PLACE,
    vehicle_type=_S, promo_code_id=_L, payment_method=_S, trip_date=_D,
    latest_event_id=_L, latest_event_ts=_N, last_ingested_at=_N,
)

DIM_DRIVER = _schema(
    driver_sk=_S, driver_id=_L, driver_name=_S, city_id=_I, vehicle_type=_S, rating=T.DecimalType(3, 2),
    driver_status=_S, valid_from=_D, valid_to=_D, is_current=_B, scd2_hash=_S,
)

# Fixed values of the data contract.
STATUS_PRECEDENCE = {
    "requested": 1,
    "driver_assigned": 2,
    "picked_up": 3,
    "completed": 4,
    "cancelled_by_rider": 4,
    "cancelled_by_driver": 4,
    "no_driver_found": 4,
}
#: Profiling ranks the regular lifecycle only; other states have no rank.
LIFECYCLE_RANK = {"requested": 1, "driver_assigned": 2, "picked_up": 3, "completed": 4}
UNKNOWN_KEY, UNKNOWN_ID = "UNKNOWN_DRIVER", -1
INFERRED_PREFIX = "INFERRED_DRIVER_"
NULL_MARK, SEPARATOR = "<NULL>", "||"
OPEN_END, UNKNOWN_START = dt.date(9999, 12, 31), dt.date(1900, 1, 1)
LOOKBACK_DAYS = 2
FARE_RANGE = (0, 10000)
MEGABYTE = 1024 * 1024
SMALL_FILE_MB = (1, 16, 64, 128)
SCD1_COLUMNS = ("driver_name", "rating")
SCD2_COLUMNS = ("city_id", "vehicle_type", "driver_status")
