"""Nine assertions over the event log (C11), their row flags and a quarantine split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import on_days, outside
from tidemark.functions.schemas import FARE_RANGE
from tidemark.operators.latest import BUSINESS_KEY, duplicate_groups, duplicate_members, regressions_from_highest

#: Check -> (category, action on failure), as reported.
CHECKS = {
    "EVENT_INGESTION_TIME_CONSISTENCY": ("FRESHNESS", "ALERT"),
    "DAILY_EVENT_VOLUME": ("VOLUME", "BLOCK"),
    "COMPLETED_TRIP_NULL_FARE": ("SCHEMA", "QUARANTINE"),
    "COMPLETED_TRIP_MISSING_DRIVER": ("REFERENTIAL_INTEGRITY", "ALERT"),
    "FARE_OUT_OF_ACCEPTED_RANGE": ("DISTRIBUTION", "QUARANTINE"),
    "INVALID_PICKUP_COORDINATES": ("BUSINESS_RULE", "QUARANTINE"),
    "INVALID_DROPOFF_COORDINATES": ("BUSINESS_RULE", "QUARANTINE"),
    "LOGICAL_DUPLICATE_EVENT": ("BUSINESS_RULE", "ALERT"),
    "STATUS_REGRESSION": ("BUSINESS_RULE", "ALERT"),
}


def zero_point(lat: str, lng: str, either: bool = False) -> Column:
    """Both coordinates zero; ``either``: one is enough."""
    a, b = F.col(lat) == 0, F.col(lng) == 0
    return (a | b) if either else (a & b)


def invalid_point(lat: str, lng: str, either_zero: bool = False) -> Column:
    """Out of bounds (P6), or zero."""
    return outside(lat, -90, 90) | outside(lng, -180, 180) | zero_point(lat, lng, either_zero)


def row_rules(fare_range: tuple[float, float] = FARE_RANGE) -> dict[str, Column]:
    """Checks that a single row decides."""
    done = F.col("status") == "completed"
    return {
        "EVENT_INGESTION_TIME_CONSISTENCY": F.col("ingested_at") < F.col("event_ts"),
        "COMPLETED_TRIP_NULL_FARE": done & F.col("fare_amount").isNull(),
        "COMPLETED_TRIP_MISSING_DRIVER": done & F.col("driver_id").isNull(),
        "FARE_OUT_OF_ACCEPTED_RANGE": (F.col("fare_amount") < fare_range[0]) | (F.col("fare_amount") > fare_range[1]),
        "INVALID_PICKUP_COORDINATES": invalid_point("pickup_lat", "pickup_lng"),
        "INVALID_DROPOFF_COORDINATES": (F.col("dropoff_lat").isNotNull() | F.col("dropoff_lng").isNotNull()) & invalid_point("dropoff_lat", "dropoff_lng"),
    }


def summary(log: DataFrame, processing_date: dt.date, fare_range: tuple[float, float] = FARE_RANGE) -> DataFrame:
    """One row per check with its failed records; seven checks share one scan."""
    rules = row_rules(fare_range)
    day = on_days("ingested_at", processing_date, processing_date)
    volume = F.when(F.count_if(day) == 0, 1).otherwise(0)
    wide = log.agg(volume.cast("long").alias("DAILY_EVENT_VOLUME"), *(F.count_if(rule).alias(name) for name, rule in rules.items()))
    counted = wide.select(F.inline(F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(name).alias("failed_record_count")) for name in ["DAILY_EVENT_VOLUME", *rules]))))
    for name, rows in (("LOGICAL_DUPLICATE_EVENT", duplicate_groups(log)), ("STATUS_REGRESSION", regressions_from_highest(log))):
        counted = counted.unionByName(rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("failed_record_count")))
    category, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (c, a) in CHECKS.items():
        category = F.when(F.col("check_name") == name, c).otherwise(category)
        action = F.when(F.col("check_name") == name, a).otherwise(action)
    out = counted.select("check_name", category.alias("category"), action.alias("failure_action"), "failed_record_count", F.when(F.col("failed_record_count") > 0, "FAILED").otherwise("PASSED").alias("check_status"))
    return out.orderBy("category", "check_name")


def flagged_rows(log: DataFrame, fare_range: tuple[float, float] = FARE_RANGE) -> DataFrame:
    """(event_id, check_name) of every row that fails a check."""
    rules = row_rules(fare_range)
    failed = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    single = log.select("event_id", F.explode(failed).alias("check_name"))
    repeated = duplicate_members(log, BUSINESS_KEY).select("event_id", F.lit("LOGICAL_DUPLICATE_EVENT").alias("check_name"))
    back = regressions_from_highest(log).select("event_id", F.lit("STATUS_REGRESSION").alias("check_name"))
    return single.unionByName(repeated).unionByName(back)


def quarantine_split(log: DataFrame, fare_range: tuple[float, float] = FARE_RANGE) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail a QUARANTINE check): an extension, the plans themselves don't filter."""
    bad = F.lit(False)
    for name, rule in row_rules(fare_range).items():
        if CHECKS[name][1] == "QUARANTINE":
            bad = bad | F.coalesce(rule, F.lit(False))
    return log.filter(~bad), log.filter(bad)


def may_publish(summarised: DataFrame) -> bool:
    """Whether no BLOCK check failed."""
    return not summarised.filter("failure_action = 'BLOCK' AND check_status = 'FAILED'").limit(1).count()
