"""Registered queries over the driver's tables, each with the SQL it is held against.

The tables stand in for the domain's inputs: ``events`` for the event log (with
replays and duplicates made from it), ``supplier`` for driver snapshots of two
days, ``documents`` for an object inventory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import on_days, parsed_time
from tidemark.functions.schemas import DIM_DRIVER
from tidemark.operators import compare, latest, merge, profiles
from tidemark.plans import current_state as rebuild
from tidemark.plans import dataset_checks, driver_history, event_quality, members, reports, trip_metrics
from tidemark.sources import files
from tidemark.sources.versioned import BucketedTable, VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = dt.date(2024, 1, 10)
FARES = (0, 100)

_LOG_COLUMNS = """event_id, user_id AS trip_id, user_id * 10 + event_id % 3 AS rider_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 37 END AS driver_id, CAST(event_id % 5 AS INT) AS city_id,
  CASE event_type WHEN 'signup' THEN 'requested' WHEN 'view' THEN 'driver_assigned' WHEN 'click' THEN 'picked_up'
    WHEN 'purchase' THEN 'completed' ELSE 'cancelled_by_rider' END AS status,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN -value ELSE value END AS fare_amount,
  CAST(1 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 4 AS surge_multiplier,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 400 AS DOUBLE) / 10 END AS distance_km,
  CAST(event_id % 220 - 110 AS DOUBLE) AS pickup_lat, CAST(event_id % 380 - 190 AS DOUBLE) AS pickup_lng,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 190 - 90 AS DOUBLE) END AS dropoff_lat,
  CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN CAST(event_id % 400 - 200 AS DOUBLE) END AS dropoff_lng,
  CASE event_id % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'comfort' ELSE 'premium' END AS vehicle_type,
  CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 97 AS BIGINT) END AS promo_code_id, date_trunc('hour', ts) AS event_ts"""
_PAYMENT = "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'card' END AS payment_method"
#: The log in SQL of either engine; ``{delay}`` and ``{replay}`` add minutes to ts.
_LOG = f"SELECT {_LOG_COLUMNS}, {{delay}} AS ingested_at, {_PAYMENT} FROM events UNION ALL SELECT {_LOG_COLUMNS.replace('ELSE value END', 'ELSE value + 1 END')}, {{replay}} AS ingested_at, {_PAYMENT} FROM events WHERE event_id % 50 = 0"
_LOG_ORDER = "event_id trip_id rider_id driver_id city_id status fare_amount surge_multiplier distance_km pickup_lat pickup_lng dropoff_lat dropoff_lng vehicle_type promo_code_id event_ts ingested_at payment_method".split()
_DUCK_LOG = _LOG.format(delay="ts + to_minutes(event_id % 4320 - 60)", replay="ts + to_minutes(event_id % 4320 + 1380)")

_DRIVERS = """s_suppkey AS driver_id, s_name AS driver_name, {city} AS city_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'comfort' ELSE 'premium' END AS vehicle_type, {rating} AS rating,
  CASE WHEN s_suppkey % 4 = 0 THEN 'suspended' ELSE 'active' END AS driver_status, CAST('{date}' AS DATE) AS snapshot_date"""
_DAY1 = "SELECT " + _DRIVERS.format(city="s_nationkey", rating="s_acctbal", date="2024-01-01") + " FROM supplier WHERE s_suppkey % 13 <> 0"
_DAY2 = "SELECT " + _DRIVERS.format(city="CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END", rating="CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END", date="2024-01-02") + " FROM supplier WHERE s_suppkey % 11 <> 0"
_TRACKED = ("city_id", "vehicle_type", "rating", "driver_status")

_INVENTORY = "SELECT concat('lake/', source, '/event_date=2024-01-', CASE WHEN doc_id % 28 < 9 THEN '0' ELSE '' END, CAST(doc_id % 28 + 1 AS {text}), '/part-', CAST(doc_id AS {text}), '.parquet') AS key, n_chars * 1024 AS size_bytes, CASE WHEN doc_id % 5 = 0 THEN 'ARCHIVE' WHEN doc_id % 7 <> 0 THEN 'STANDARD' END AS storage_class FROM documents"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {table}", "FROM {rows}"), rows=_read(spark, sf_dir, table))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = "ts + make_dt_interval(0, 0, CAST({} AS INT), 0)"
    text = _LOG.format(delay=minutes.format("event_id % 4320 - 60"), replay=minutes.format("event_id % 4320 + 1380"))
    return _sql(spark, sf_dir, "events", text).select(*_LOG_ORDER)


def short_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with shorter trips: some end at every milestone, and a day touches some of them only."""
    return event_log(spark, sf_dir).withColumn("trip_id", F.col("trip_id") * 100 + F.col("event_id") % 20)


def day1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "supplier", _DAY1)


def day2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "supplier", _DAY2)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "documents", _INVENTORY.format(text="STRING"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension after the first day."""
    first = day1(spark, sf_dir)
    kinds = {f.name: f.dataType for f in first.schema}
    empty = first.limit(0).select(*(F.lit(None).cast(kinds.get(f.name, f.dataType)).alias(f.name) for f in DIM_DRIVER))
    return driver_history.apply_snapshot(empty, first, check=False)


def partial_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension without every ninth driver, so that facts miss members."""
    return dimension(spark, sf_dir).filter("driver_id % 9 <> 0")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select(F.col("event_id").alias("trip_id"), "driver_id")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- SQL blocks of the oracles

_W_LOG = f"WITH log AS ({_DUCK_LOG})"
_W_SHORT = f"WITH log AS (SELECT * REPLACE (trip_id * 100 + event_id % 20 AS trip_id) FROM ({_DUCK_LOG}))"
_PRECEDENCE = "CASE status WHEN 'requested' THEN 1 WHEN 'driver_assigned' THEN 2 WHEN 'picked_up' THEN 3 WHEN 'completed' THEN 4 WHEN 'cancelled_by_rider' THEN 4 WHEN 'cancelled_by_driver' THEN 4 WHEN 'no_driver_found' THEN 4 ELSE 0 END"
_AFFECTED = "affected AS (SELECT DISTINCT trip_id FROM log WHERE CAST(ingested_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-10')"
_EXACT = "exact AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) AS rn FROM {source}) WHERE rn = 1)"
_BUSINESS = "business AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, status, event_ts ORDER BY ingested_at DESC, event_id DESC) AS rn FROM {source}) WHERE rn = 1)"
_CURRENT_COLUMNS = "trip_id, rider_id, driver_id, city_id, status AS current_status, fare_amount, surge_multiplier, distance_km, pickup_lat, pickup_lng, dropoff_lat, dropoff_lng, vehicle_type, promo_code_id, payment_method, trip_date, event_id AS latest_event_id, event_ts AS latest_event_ts, ingested_at AS last_ingested_at"
_CURRENT = f"""dates AS (SELECT trip_id, CAST(min(event_ts) FILTER (WHERE status = 'requested') AS DATE) AS trip_date FROM business GROUP BY trip_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY {_PRECEDENCE} DESC, event_ts DESC, event_id DESC) AS rn FROM business),
  current AS (SELECT {_CURRENT_COLUMNS} FROM ranked LEFT JOIN dates USING (trip_id) WHERE rn = 1)"""
_HISTORY = "history AS (SELECT * FROM log WHERE trip_id IN (SELECT trip_id FROM affected))"
_MILESTONES = """milestones AS (SELECT trip_id, arg_min_null(rider_id, (event_ts, event_id)) AS rider_id,
  arg_max(driver_id, (event_ts, event_id)) FILTER (WHERE driver_id IS NOT NULL) AS driver_id,
  arg_min_null(city_id, (event_ts, event_id)) AS city_id, arg_min_null(vehicle_type, (event_ts, event_id)) AS vehicle_type,
  min(event_ts) FILTER (WHERE status = 'requested') AS requested_at, min(event_ts) FILTER (WHERE status = 'driver_assigned') AS driver_assigned_at,
  min(event_ts) FILTER (WHERE status = 'picked_up') AS picked_up_at, min(event_ts) FILTER (WHERE status = 'completed') AS completed_at,
  arg_max_null(fare_amount, (event_ts, event_id)) FILTER (WHERE status = 'completed') AS fare_amount,
  arg_max_null(distance_km, (event_ts, event_id)) FILTER (WHERE status = 'completed') AS distance_km,
  arg_max_null(payment_method, (event_ts, event_id)) FILTER (WHERE status = 'completed') AS payment_method,
  max(surge_multiplier) AS surge_multiplier FROM business GROUP BY trip_id)"""
_LIFECYCLE = "CASE WHEN completed_at IS NOT NULL THEN 'completed' WHEN picked_up_at IS NOT NULL THEN 'picked_up' WHEN driver_assigned_at IS NOT NULL THEN 'driver_assigned' ELSE 'requested' END"
_METRICS = f"""SELECT trip_id, rider_id, driver_id, city_id, vehicle_type, CAST(requested_at AS DATE) AS trip_date, requested_at, driver_assigned_at, picked_up_at, completed_at,
  date_sub('second', requested_at, driver_assigned_at) AS time_to_assign_seconds, date_sub('second', driver_assigned_at, picked_up_at) AS wait_to_pickup_seconds,
  date_sub('second', picked_up_at, completed_at) AS trip_duration_seconds, date_sub('second', requested_at, completed_at) AS total_trip_lifecycle_seconds,
  fare_amount, distance_km, surge_multiplier, payment_method, {_LIFECYCLE} AS lifecycle_status FROM milestones"""
_BAD_PICKUP = "(pickup_lat NOT BETWEEN -90 AND 90 OR pickup_lng NOT BETWEEN -180 AND 180 OR (pickup_lat = 0 AND pickup_lng = 0))"
_BAD_DROPOFF = "((dropoff_lat IS NOT NULL OR dropoff_lng IS NOT NULL) AND (dropoff_lat NOT BETWEEN -90 AND 90 OR dropoff_lng NOT BETWEEN -180 AND 180 OR (dropoff_lat = 0 AND dropoff_lng = 0)))"
_ROW_RULES = {
    "EVENT_INGESTION_TIME_CONSISTENCY": "ingested_at < event_ts",
    "COMPLETED_TRIP_NULL_FARE": "status = 'completed' AND fare_amount IS NULL",
    "COMPLETED_TRIP_MISSING_DRIVER": "status = 'completed' AND driver_id IS NULL",
    "FARE_OUT_OF_ACCEPTED_RANGE": "fare_amount < 0 OR fare_amount > 100",
    "INVALID_PICKUP_COORDINATES": _BAD_PICKUP,
    "INVALID_DROPOFF_COORDINATES": _BAD_DROPOFF,
}
_BACK = f"back AS (SELECT * FROM (SELECT *, max(status_precedence) OVER (PARTITION BY trip_id ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM (SELECT *, {_PRECEDENCE} AS status_precedence FROM log)) WHERE status_precedence < highest_before)"
_GROUPS = "groups AS (SELECT trip_id, status, event_ts, count(*) AS rows_in_group FROM log GROUP BY ALL HAVING count(*) > 1)"
_HASH = "upper(md5(coalesce(CAST(city_id AS VARCHAR), '<NULL>') || '||' || coalesce(vehicle_type, '<NULL>') || '||' || coalesce(driver_status, '<NULL>')))"
_KEY = "upper(md5(CAST(driver_id AS VARCHAR) || '||' || CAST(snapshot_date AS VARCHAR)))"
_DIM = f"""day1 AS ({_DAY1}), day2 AS ({_DAY2}),
  dim AS (SELECT {_KEY} AS driver_sk, driver_id, driver_name, city_id, vehicle_type, rating, driver_status, snapshot_date AS valid_from, DATE '9999-12-31' AS valid_to, TRUE AS is_current, {_HASH} AS scd2_hash FROM day1)"""
_CHANGES = f"""hashed AS (SELECT *, {_HASH} AS scd2_hash FROM day2),
  changes AS (SELECT h.*, CASE WHEN d.driver_id IS NULL THEN 'NEW' WHEN d.driver_status = 'inferred' THEN 'INFERRED_RESOLUTION' WHEN h.scd2_hash IS DISTINCT FROM d.scd2_hash THEN 'SCD2_CHANGE'
    WHEN h.driver_name IS DISTINCT FROM d.driver_name OR h.rating IS DISTINCT FROM d.rating THEN 'SCD1_CHANGE' ELSE 'UNCHANGED' END AS change_type FROM hashed h LEFT JOIN dim d ON h.driver_id = d.driver_id)"""
_VERSIONS = f"versions AS (SELECT {_KEY} AS driver_sk, driver_id, driver_name, city_id, vehicle_type, rating, driver_status, snapshot_date AS valid_from, DATE '9999-12-31' AS valid_to, TRUE AS is_current, scd2_hash FROM changes WHERE change_type IN ('NEW', 'SCD2_CHANGE'))"
_EXPIRED = "expired AS (SELECT d.* REPLACE (CASE WHEN c.change_type = 'SCD2_CHANGE' THEN c.snapshot_date - 1 ELSE d.valid_to END AS valid_to, coalesce(c.change_type, '') <> 'SCD2_CHANGE' AS is_current) FROM dim d LEFT JOIN changes c USING (driver_id))"
_W_DIM = f"WITH {_DIM}"
_W_SCD = f"WITH {_DIM}, {_CHANGES}, {_VERSIONS}, {_EXPIRED}"
_W_TRIPS = f"WITH {_DIM}, log AS ({_DUCK_LOG}), trips AS (SELECT event_id AS trip_id, driver_id FROM log), part AS (SELECT * FROM dim WHERE driver_id % 9 <> 0)"
_W_FILES = f"WITH files AS (SELECT *, size_bytes / 1048576 AS size_mb, nullif(regexp_extract(key, 'event_date=(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS event_date FROM ({_INVENTORY.format(text='VARCHAR')}))"


def _figures(x: str) -> str:
    return f"count({x}) AS count, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, CAST(min({x}) AS DOUBLE) AS min, round(quantile_cont({x}, 0.25), 4) AS p25, round(quantile_cont({x}, 0.5), 4) AS p50, round(quantile_cont({x}, 0.75), 4) AS p75, CAST(max({x}) AS DOUBLE) AS max"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order; four places don't."""
    return df.select(*(F.round(c, 4).alias(c) if c in (columns or ("mean", "std", "p25", "p50", "p75")) else F.col(c) for c in df.columns))


# ---- current state of trips


@query(f"{_W_LOG}, {_EXACT.format(source='log')}, {_BUSINESS.format(source='exact')}, {_CURRENT} SELECT * FROM current")
def current_state(spark, sf_dir):
    return current_state_of(event_log(spark, sf_dir))


def current_state_of(log: DataFrame) -> DataFrame:
    return rebuild.current_rows(rebuild.logical_events(log))


@query(f"{_W_LOG}, {_AFFECTED} SELECT trip_id FROM affected")
def affected_keys(spark, sf_dir):
    return rebuild.affected_trips(event_log(spark, sf_dir), DAY)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-03')")
def semi_join_reduction(spark, sf_dir):
    chosen = _read(spark, sf_dir, "orders").filter(on_days("o_orderdate", dt.date(1995, 3, 1), dt.date(1995, 3, 3)))
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(chosen, lines["l_orderkey"] == chosen["o_orderkey"], "left_semi")


@query(f"{_W_LOG}, {_EXACT.format(source='log')} SELECT * FROM exact")
def dedup_exact(spark, sf_dir):
    return latest.drop_replays(event_log(spark, sf_dir))


@query(f"{_W_LOG}, {_BUSINESS.format(source='log')} SELECT * FROM business")
def dedup_business(spark, sf_dir):
    return latest.drop_business_duplicates(event_log(spark, sf_dir))


@query(f"{_W_LOG}, {_AFFECTED}, {_HISTORY}, {_EXACT.format(source='history')}, {_BUSINESS.format(source='exact')} SELECT * FROM business")
def dedup_two_levels(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return rebuild.logical_events(rebuild.history_of(log, rebuild.affected_trips(log, DAY)))


@query(f"{_W_LOG}, {_AFFECTED}, {_HISTORY}, {_EXACT.format(source='history')}, {_BUSINESS.format(source='exact')}, {_CURRENT} SELECT * FROM current")
def current_trips_incremental(spark, sf_dir):
    return rebuild.build_current(event_log(spark, sf_dir), DAY)


@query(f"{_W_LOG}, {_EXACT.format(source='log')}, {_BUSINESS.format(source='exact')}, {_CURRENT}, target AS (SELECT * REPLACE ('stale' AS current_status) FROM current WHERE trip_id % 2 = 0), source AS (SELECT * FROM current WHERE trip_id % 3 = 0) SELECT * FROM source UNION ALL SELECT * FROM target WHERE trip_id NOT IN (SELECT trip_id FROM source)")
def upsert_result(spark, sf_dir):
    rows = current_state_of(event_log(spark, sf_dir))
    target = rows.filter("trip_id % 2 = 0").withColumn("current_status", F.lit("stale"))
    return merge.upsert(target, rows.filter("trip_id % 3 = 0"), ["trip_id"], check=False)


@query(f"{_W_SHORT}, {_AFFECTED}, {_HISTORY}, {_EXACT.format(source='history')}, {_BUSINESS.format(source='exact')}, {_CURRENT}, target AS (SELECT trip_id FROM log GROUP BY 1 HAVING trip_id % 4 <> 0) SELECT * FROM current UNION ALL SELECT t.trip_id, * EXCLUDE (trip_id) REPLACE ('stale' AS current_status) FROM target t LEFT JOIN (SELECT * FROM current WHERE FALSE) c USING (trip_id) WHERE t.trip_id NOT IN (SELECT trip_id FROM current)")
def current_applied_twice(spark, sf_dir):
    """The current table of three quarters of the trips, known by id only, after the same date was applied to it twice."""
    log = short_trips(spark, sf_dir)
    columns = rebuild.build_current(log, DAY)
    known = log.select("trip_id").distinct().filter("trip_id % 4 <> 0")
    target = known.select(*(F.col("trip_id") if f.name == "trip_id" else F.lit("stale" if f.name == "current_status" else None).cast(f.dataType).alias(f.name) for f in columns.schema))
    return rebuild.apply_current(rebuild.apply_current(target, log, DAY), log, DAY)


@query(f"{_W_LOG}, {_BUSINESS.format(source='log')} SELECT trip_id, CAST(min(event_ts) FILTER (WHERE status = 'requested') AS DATE) AS trip_date FROM business GROUP BY trip_id")
def trip_dates_min_filter(spark, sf_dir):
    rows = latest.drop_business_duplicates(event_log(spark, sf_dir))
    return rows.groupBy("trip_id").agg(F.min(F.when(F.col("status") == "requested", F.col("event_ts"))).cast("date").alias("trip_date"))


# ---- trip metrics


@query(f"{_W_LOG}, {_BUSINESS.format(source='log')}, {_MILESTONES} SELECT * FROM milestones")
def milestones(spark, sf_dir):
    return trip_metrics.milestones(latest.drop_business_duplicates(event_log(spark, sf_dir)))


@query(f"{_W_LOG}, {_BUSINESS.format(source='log')}, {_MILESTONES} SELECT * FROM ({_METRICS}) WHERE trip_date = DATE '2024-01-02'")
def lifecycle_metrics(spark, sf_dir):
    return trip_metrics.trip_metrics(event_log(spark, sf_dir), dt.date(2024, 1, 2))


@query(f"{_W_SHORT}, {_BUSINESS.format(source='log')}, {_MILESTONES} SELECT lifecycle_status, count(*) AS n FROM ({_METRICS}) GROUP BY 1")
def lifecycle_status_counts(spark, sf_dir):
    return profiles.value_counts(trip_metrics.trip_metrics(short_trips(spark, sf_dir)), "lifecycle_status", keep_null=True)


# ---- quality of the log

_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {v}) AS failed_record_count FROM log" for k, v in _ROW_RULES.items())
_CHECK_ROWS = ", ".join(f"('{k}', '{c}', '{a}')" for k, (c, a) in event_quality.CHECKS.items())


@query(f"""{_W_LOG}, {_GROUPS}, {_BACK}, counts AS ({_COUNTS}
  UNION ALL SELECT 'DAILY_EVENT_VOLUME', CASE WHEN count(*) FILTER (WHERE CAST(ingested_at AS DATE) = DATE '2024-01-10') = 0 THEN 1 ELSE 0 END FROM log
  UNION ALL SELECT 'LOGICAL_DUPLICATE_EVENT', count(*) FROM groups UNION ALL SELECT 'STATUS_REGRESSION', count(*) FROM back)
  SELECT check_name, category, failure_action, CAST(failed_record_count AS BIGINT) AS failed_record_count, CASE WHEN failed_record_count > 0 THEN 'FAILED' ELSE 'PASSED' END AS check_status
  FROM counts JOIN (VALUES {_CHECK_ROWS}) AS c(check_name, category, failure_action) USING (check_name)""")
def quality_summary(spark, sf_dir):
    return event_quality.summary(event_log(spark, sf_dir), DAY, FARES)


_FLAGS = " UNION ALL ".join(f"SELECT event_id, '{k}' AS check_name FROM log WHERE {v}" for k, v in _ROW_RULES.items())


@query(f"{_W_LOG}, {_GROUPS}, {_BACK} {_FLAGS} UNION ALL SELECT event_id, 'LOGICAL_DUPLICATE_EVENT' FROM log JOIN groups USING (trip_id, status, event_ts) UNION ALL SELECT event_id, 'STATUS_REGRESSION' FROM back")
def quality_row_flags(spark, sf_dir):
    return event_quality.flagged_rows(event_log(spark, sf_dir), FARES)


@query(f"{_W_LOG} SELECT * FROM log WHERE " + " OR ".join(f"({_ROW_RULES[k]})" for k, (_, a) in event_quality.CHECKS.items() if a == "QUARANTINE" and k in _ROW_RULES))
def quarantined_rows(spark, sf_dir):
    return event_quality.quarantine_split(event_log(spark, sf_dir), FARES)[1]


@query(f"{_W_LOG} SELECT * FROM log WHERE NOT coalesce(" + " OR ".join(f"coalesce({_ROW_RULES[k]}, FALSE)" for k, (_, a) in event_quality.CHECKS.items() if a == "QUARANTINE" and k in _ROW_RULES) + ", FALSE)")
def accepted_rows(spark, sf_dir):
    return event_quality.quarantine_split(event_log(spark, sf_dir), FARES)[0]


@query(f"{_W_LOG} SELECT d AS processing_date, count(ingested_at) > 0 AS may_publish FROM (VALUES (DATE '2024-01-10'), (DATE '2031-01-01')) AS days(d) LEFT JOIN log ON CAST(ingested_at AS DATE) = d GROUP BY d")
def publication_gate(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return spark.createDataFrame([(d, event_quality.may_publish(event_quality.summary(log, d, FARES))) for d in (DAY, dt.date(2031, 1, 1))], "processing_date date, may_publish boolean")


@query(f"{_W_LOG} SELECT * FROM log WHERE pickup_lat = 0 OR pickup_lng = 0")
def zero_pickups(spark, sf_dir):
    return reports.event_report(event_log(spark, sf_dir), FARES)["zero_pickups"]


@query(f"{_W_LOG} SELECT * FROM log WHERE pickup_lat NOT BETWEEN -90 AND 90 OR pickup_lng NOT BETWEEN -180 AND 180 OR pickup_lat = 0 OR pickup_lng = 0")
def invalid_pickups_either_zero(spark, sf_dir):
    return event_log(spark, sf_dir).filter(event_quality.invalid_point("pickup_lat", "pickup_lng", either_zero=True))


@query(f"{_W_LOG} SELECT * FROM log WHERE fare_amount < 0 OR fare_amount > 100")
def range_violations(spark, sf_dir):
    return reports.event_report(event_log(spark, sf_dir), FARES)["odd_fares"]


@query(f"{_W_LOG}, {_GROUPS} SELECT * FROM groups")
def duplicate_groups(spark, sf_dir):
    return latest.duplicate_groups(event_log(spark, sf_dir))


@query(f"{_W_LOG}, {_GROUPS} SELECT log.*, rows_in_group FROM log JOIN groups USING (trip_id, status, event_ts)")
def duplicate_members(spark, sf_dir):
    return latest.duplicate_members(event_log(spark, sf_dir))


@query(f"{_W_LOG}, ranked AS (SELECT *, {_PRECEDENCE} AS status_precedence FROM log) SELECT * FROM (SELECT *, max(status_precedence) OVER (PARTITION BY trip_id ORDER BY event_ts, event_id, ingested_at, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM ranked) WHERE status_precedence < highest_before")
def status_regression_running_max(spark, sf_dir):
    return latest.regressions_from_highest(event_log(spark, sf_dir))


@query(f"{_W_LOG}, ranked AS (SELECT *, CASE status WHEN 'requested' THEN 1 WHEN 'driver_assigned' THEN 2 WHEN 'picked_up' THEN 3 WHEN 'completed' THEN 4 END AS status_rank FROM log) SELECT * FROM (SELECT *, lag(status_rank) OVER (PARTITION BY trip_id ORDER BY event_ts, event_id, ingested_at, status) AS previous_rank FROM ranked) WHERE status_rank < previous_rank")
def status_regression_lag(spark, sf_dir):
    return latest.regressions_from_previous(event_log(spark, sf_dir))


# ---- driver dimension


@query(f"WITH day1 AS ({_DAY1}) SELECT *, {_HASH} AS scd2_hash FROM day1")
def snapshot_hash(spark, sf_dir):
    return driver_history.with_hash(day1(spark, sf_dir))


@query(f"{_W_SCD} SELECT * FROM changes")
def snapshot_classify(spark, sf_dir):
    return driver_history.classify(day2(spark, sf_dir), dimension(spark, sf_dir))


@query(f"{_W_SCD} SELECT * FROM expired")
def scd_expire(spark, sf_dir):
    dim = dimension(spark, sf_dir)
    return driver_history.expire(dim, driver_history.classify(day2(spark, sf_dir), dim))


@query(f"{_W_SCD} SELECT * FROM versions")
def scd_new_versions(spark, sf_dir):
    return driver_history.new_versions(driver_history.classify(day2(spark, sf_dir), dimension(spark, sf_dir)))


@query(f"{_W_SCD} SELECT d.* REPLACE (coalesce(c.driver_name, d.driver_name) AS driver_name, coalesce(c.rating, d.rating) AS rating) FROM dim d LEFT JOIN changes c USING (driver_id)")
def scd1_apply_result(spark, sf_dir):
    dim = dimension(spark, sf_dir)
    return driver_history.overwrite_type1(dim, driver_history.classify(day2(spark, sf_dir), dim))


@query(f"{_W_SCD} SELECT * FROM versions UNION ALL SELECT e.* REPLACE (CASE WHEN e.is_current THEN coalesce(c.rating, e.rating) ELSE e.rating END AS rating) FROM expired e LEFT JOIN changes c USING (driver_id)")
def scd2_apply_result(spark, sf_dir):
    return driver_history.apply_snapshot(dimension(spark, sf_dir), day2(spark, sf_dir), check=False)


_INFERRED = "SELECT 'INFERRED_DRIVER_' || CAST(driver_id AS VARCHAR) AS driver_sk, driver_id, 'Inferred Driver' AS driver_name, CAST(NULL AS INT) AS city_id, CAST(NULL AS VARCHAR) AS vehicle_type, CAST(NULL AS DOUBLE) AS rating, 'inferred' AS driver_status, DATE '1900-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, TRUE AS is_current, CAST(NULL AS VARCHAR) AS scd2_hash FROM missing"
_MISSING = "missing AS (SELECT DISTINCT driver_id FROM trips WHERE driver_id IS NOT NULL AND driver_id NOT IN (SELECT driver_id FROM part))"
_UNKNOWN = "SELECT 'UNKNOWN_DRIVER' AS driver_sk, CAST(-1 AS BIGINT) AS driver_id, 'Unknown Driver' AS driver_name, NULL AS city_id, NULL AS vehicle_type, NULL AS rating, 'unknown' AS driver_status, DATE '1900-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, TRUE AS is_current, NULL AS scd2_hash"


@query(f"{_W_TRIPS}, {_MISSING}, before AS (SELECT * FROM part UNION ALL {_INFERRED}), hashed AS (SELECT *, {_HASH} AS scd2_hash FROM day2) SELECT b.* REPLACE (coalesce(h.driver_name, b.driver_name) AS driver_name, coalesce(h.city_id, b.city_id) AS city_id, coalesce(h.vehicle_type, b.vehicle_type) AS vehicle_type, coalesce(h.rating, b.rating) AS rating, coalesce(h.driver_status, b.driver_status) AS driver_status, coalesce(h.scd2_hash, b.scd2_hash) AS scd2_hash) FROM before b LEFT JOIN hashed h ON b.driver_id = h.driver_id AND b.driver_status = 'inferred'")
def scd_resolve_inferred(spark, sf_dir):
    dim = members.add_inferred(partial_dimension(spark, sf_dir), trips(spark, sf_dir))
    return driver_history.resolve_inferred(dim, driver_history.classify(day2(spark, sf_dir), dim))


@query(f"{_W_TRIPS}, {_MISSING} SELECT driver_id FROM missing")
def missing_members_anti(spark, sf_dir):
    return members.missing_members(trips(spark, sf_dir), partial_dimension(spark, sf_dir))


@query(f"{_W_TRIPS}, {_MISSING} {_INFERRED}")
def inferred_members(spark, sf_dir):
    dim = partial_dimension(spark, sf_dir)
    return members.inferred_members(members.missing_members(trips(spark, sf_dir), dim), dim)


@query(f"{_W_DIM} SELECT * FROM dim UNION ALL {_UNKNOWN}")
def unknown_singleton(spark, sf_dir):
    return members.add_unknown(members.add_unknown(dimension(spark, sf_dir)))


@query(f"{_W_TRIPS}, {_MISSING} SELECT * FROM part UNION ALL {_UNKNOWN} UNION ALL {_INFERRED}")
def completed_dimension(spark, sf_dir):
    return members.complete(partial_dimension(spark, sf_dir), trips(spark, sf_dir))


@query(f"{_W_TRIPS} SELECT trip_id, driver_id, coalesce(driver_sk, 'UNKNOWN_DRIVER') AS resolved_driver_sk FROM trips LEFT JOIN part USING (driver_id)")
def key_resolution(spark, sf_dir):
    return members.resolve_keys(trips(spark, sf_dir), partial_dimension(spark, sf_dir))


@query(f"{_W_SCD}, log AS ({_DUCK_LOG}), facts AS (SELECT event_id AS trip_id, driver_id, CAST(event_ts AS DATE) AS trip_date FROM log), hist AS (SELECT * FROM versions UNION ALL SELECT * FROM expired) SELECT f.trip_id, f.driver_id, f.trip_date, h.driver_sk FROM facts f LEFT JOIN hist h ON f.driver_id = h.driver_id AND f.trip_date BETWEEN h.valid_from AND h.valid_to")
def key_resolution_as_of(spark, sf_dir):
    hist = driver_history.apply_snapshot(dimension(spark, sf_dir), day2(spark, sf_dir), check=False)
    facts = event_log(spark, sf_dir).select(F.col("event_id").alias("trip_id"), "driver_id", F.col("event_ts").cast("date").alias("trip_date"))
    return driver_history.valid_on(hist, facts, "trip_date").select("trip_id", "driver_id", "trip_date", "driver_sk")


# ---- snapshot differences

_W_DAYS = f"WITH day1 AS ({_DAY1}), day2 AS ({_DAY2})"
_DIFF = " UNION ALL ".join(f"SELECT driver_id, '{c}' AS attribute, CAST(a.{c} AS VARCHAR) AS old_value, CAST(b.{c} AS VARCHAR) AS new_value FROM day1 a JOIN day2 b USING (driver_id) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in ("city_id", "vehicle_type", "driver_status"))


@query(f"{_W_DAYS} SELECT driver_id FROM day2 EXCEPT SELECT driver_id FROM day1")
def snapshot_new(spark, sf_dir):
    return compare.new_keys(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id")


@query(f"{_W_DAYS} SELECT driver_id FROM day1 EXCEPT SELECT driver_id FROM day2")
def snapshot_removed(spark, sf_dir):
    return compare.removed_keys(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id")


@query(f"{_W_DAYS} SELECT driver_id FROM day1 INTERSECT SELECT driver_id FROM day2")
def snapshot_common(spark, sf_dir):
    return compare.common_keys(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id")


_SIDES = ", ".join(f"a.{c} AS {c}_day1" for c in _TRACKED) + ", " + ", ".join(f"b.{c} AS {c}_day2" for c in _TRACKED)


@query(f"{_W_DAYS} SELECT driver_id, {_SIDES} FROM day1 a JOIN day2 b USING (driver_id)")
def snapshot_side_by_side(spark, sf_dir):
    return compare.side_by_side(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id", _TRACKED)


@query(f"{_W_DAYS} SELECT driver_id, {_SIDES} FROM day1 a JOIN day2 b USING (driver_id) WHERE " + " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _TRACKED))
def snapshot_changed_rows(spark, sf_dir):
    return compare.changed_rows(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id", _TRACKED)


@query(f"{_W_DAYS} {_DIFF}")
def snapshot_diff_long(spark, sf_dir):
    return compare.change_log(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id", ["city_id", "vehicle_type", "driver_status"])


_CHANGED = " UNION ALL ".join(f"SELECT driver_id, '{c}' AS attribute FROM day1 a JOIN day2 b USING (driver_id) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in _TRACKED)


@query(f"{_W_DAYS} SELECT attribute, count(*) AS n FROM ({_CHANGED}) GROUP BY 1")
def attribute_change_counts(spark, sf_dir):
    return reports.snapshot_report(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id", _TRACKED)["by_attribute"]


@query(f"{_W_DAYS} SELECT count(DISTINCT driver_id) AS changed_keys, count(*) AS changes FROM ({_CHANGED})")
def snapshot_totals(spark, sf_dir):
    return reports.snapshot_report(day1(spark, sf_dir), day2(spark, sf_dir), "driver_id", _TRACKED)["totals"]


# ---- profiles


@query(f"{_W_LOG} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, round_even(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_percentage FROM log" for c in _LOG_ORDER))
def null_counts(spark, sf_dir):
    return profiles.null_profile(event_log(spark, sf_dir))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, sf_dir):
    return profiles.value_counts(_read(spark, sf_dir, "lineitem"), "l_returnflag")


@query(f"{_W_LOG} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM log" for c in ("trip_id", "driver_id", "status", "promo_code_id")))
def distinct_counts(spark, sf_dir):
    return profiles.distinct_counts(event_log(spark, sf_dir), ["trip_id", "driver_id", "status", "promo_code_id"])


@query(f"SELECT {_figures('n')} FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def group_size_describe(spark, sf_dir):
    return _rounded(profiles.describe_group_sizes(_read(spark, sf_dir, "lineitem"), "l_orderkey"))


@query(f"SELECT {_figures('l_extendedprice')} FROM lineitem")
def numeric_describe(spark, sf_dir):
    return _rounded(profiles.describe(_read(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, " + _figures(c).split(", ", 1)[1] + " FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")) + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', CAST(sum(n) AS BIGINT), count(*), arg_max({c}, (n, {c})), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT {c}, count(*) AS n FROM customer GROUP BY 1)" for c in ("c_name", "c_mktsegment"))
)
def describe_all(spark, sf_dir):
    return _rounded(profiles.describe_all(_read(spark, sf_dir, "customer")))


@query(f"SELECT {_figures('l_extendedprice')} FROM lineitem")
def numeric_describe_spread(spark, sf_dir):
    return _rounded(profiles.describe_spread(_read(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_row_count(spark, sf_dir):
    return profiles.duplicate_count(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{_W_LOG} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM log GROUP BY {', '.join(c for c in _LOG_ORDER if c not in ('event_id', 'ingested_at', 'fare_amount'))})")
def duplicate_rows_of_whole_rows(spark, sf_dir):
    return profiles.duplicate_count(event_log(spark, sf_dir).drop("event_id", "ingested_at", "fare_amount"))


@query(f"{_W_LOG} SELECT event_id, event_ts FROM log")
def parsed_times(spark, sf_dir):
    """Times that come as text."""
    return event_log(spark, sf_dir).select("event_id", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("text")).select("event_id", parsed_time("text").alias("event_ts"))


@query(f"{_W_LOG} SELECT status, count(fare_amount) AS fare_amount, count(distance_km) AS distance_km, count(driver_id) AS driver_id FROM log GROUP BY 1")
def non_null_by_group(spark, sf_dir):
    return profiles.non_null_by_group(event_log(spark, sf_dir), "status", ["fare_amount", "distance_km", "driver_id"])


@query(f"{_W_LOG} SELECT trip_id, min(event_ts) AS first_event, max(event_ts) AS last_event FROM log GROUP BY 1")
def event_spans(spark, sf_dir):
    return profiles.spans_by_group(event_log(spark, sf_dir), "trip_id", "event_ts", "first_event", "last_event")


@query(f"{_W_LOG} SELECT trip_id, min(event_ts) AS first_event, max(event_ts) AS last_event FROM log GROUP BY 1 HAVING CAST(min(event_ts) AS DATE) <> CAST(max(event_ts) AS DATE)")
def midnight_span(spark, sf_dir):
    return reports.midnight_trips(event_log(spark, sf_dir))


@query(f"{_W_LOG} SELECT trip_id, string_agg(status, '>' ORDER BY event_ts, event_id, status) AS status_sequence FROM log GROUP BY 1")
def ordered_status_list(spark, sf_dir):
    rows = profiles.ordered_values(event_log(spark, sf_dir), "trip_id", ["event_ts", "event_id"], "status")
    return rows.withColumn("status_sequence", F.array_join("status_sequence", ">"))


@query(f"{_W_LOG} SELECT {_figures('d')} FROM (SELECT date_diff('microsecond', event_ts, ingested_at) / 1e6 AS d FROM log)")
def ingest_delay_stats(spark, sf_dir):
    return _rounded(reports.delay_figures(event_log(spark, sf_dir)))


@query(f"{_W_LOG} SELECT * FROM log WHERE ingested_at < event_ts")
def ingested_early(spark, sf_dir):
    return reports.late_events(event_log(spark, sf_dir))


# ---- object inventory

_THRESHOLDS = (1, 2, 4, 16)


@query(f"{_W_FILES} SELECT key, size_mb, event_date FROM files")
def regex_partition_extract(spark, sf_dir):
    return reports.with_size_and_date(inventory(spark, sf_dir)).select("key", "size_mb", "event_date")


@query(f"{_W_FILES} " + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE size_mb < {t}) AS n, round_even(100.0 * count(*) FILTER (WHERE size_mb < {t}) / count(*), 2) AS percentage FROM files" for t in _THRESHOLDS))
def small_file_thresholds(spark, sf_dir):
    return reports.inventory_report(inventory(spark, sf_dir), _THRESHOLDS)["small_files"]


@query(f"{_W_FILES} SELECT {_figures('size_mb')} FROM files")
def file_size_describe(spark, sf_dir):
    return _rounded(reports.inventory_report(inventory(spark, sf_dir))["sizes"], "mean", "std", "p25", "p50", "p75")


@query(f"{_W_FILES} SELECT event_date, count(size_mb) AS n, round(avg(size_mb), 4) AS mean, round(median(size_mb), 4) AS median, round(sum(size_mb), 4) AS total FROM files GROUP BY 1")
def partition_stats(spark, sf_dir):
    return _rounded(reports.inventory_report(inventory(spark, sf_dir))["partitions"], "mean", "median", "total")


@query(f"{_W_FILES} SELECT event_date, count(*) AS n FROM files GROUP BY 1")
def files_by_date(spark, sf_dir):
    return reports.inventory_report(inventory(spark, sf_dir))["files_by_date"]


@query(f"{_W_FILES} SELECT storage_class, count(*) AS n FROM files GROUP BY 1")
def storage_classes(spark, sf_dir):
    return reports.inventory_report(inventory(spark, sf_dir))["storage_classes"]


@query(f"{_W_FILES} SELECT key, size_mb FROM files ORDER BY size_mb DESC, key LIMIT 15")
def largest_topk(spark, sf_dir):
    return reports.inventory_report(inventory(spark, sf_dir))["largest"].select("key", "size_mb")


@query(f"{_W_FILES} SELECT key, size_mb FROM files ORDER BY size_mb, key LIMIT 20")
def smallest_topk(spark, sf_dir):
    return reports.inventory_report(inventory(spark, sf_dir))["smallest"].select("key", "size_mb")


# ---- rule-driven validation of any table

RULES = {
    "null_checks": {"columns": ["event_id", "driver_id", "fare_amount", "promo_code_id"], "threshold": 15},
    "duplicate_checks": {"subset": ["event_id"]},
    "data_type_checks": {"event_id": "INT", "status": "str", "fare_amount": "float64", "city_id": "string", "nowhere": "int"},
    "range_checks": [{"column": "fare_amount", "min_value": 0, "max_value": 100}, {"column": "surge_multiplier", "min_value": 1}, {"column": "pickup_lat", "max_value": 90}, {"column": "nowhere", "min_value": 0}],
}


def _null_sql(table: str, threshold: float, *columns: str) -> str:
    share = "100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)"
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, round_even({share.format(c=c)}, 2) AS null_percentage, {share.format(c=c)} <= {threshold} AS passed FROM {table}" for c in columns)


def _range_sql(table: str, *rules: dict) -> str:
    def outside(r: dict) -> str:
        return " OR ".join(f"{r['column']} {sign} {r[bound]}" for bound, sign in (("min_value", "<"), ("max_value", ">")) if bound in r)

    return " UNION ALL ".join(f"SELECT '{r['column']}' AS column_name, count(*) FILTER (WHERE {outside(r)}) AS violations, round_even(100.0 * count(*) FILTER (WHERE {outside(r)}) / count({r['column']}), 2) AS violation_percentage, count(*) FILTER (WHERE {outside(r)}) = 0 AS passed FROM {table}" for r in rules)


def _repeat_sql(table: str, subset: str, label: str) -> str:
    return f"SELECT '{label}' AS keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round_even(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_percentage, CAST(sum(n) AS BIGINT) AS total_rows, sum(n - 1) = 0 AS passed FROM (SELECT count(*) AS n FROM {table} GROUP BY {subset})"


@query(f"{_W_LOG} " + _null_sql("log", 10, *_LOG_ORDER))
def checked_nulls(spark, sf_dir):
    found = dataset_checks.DataQualityChecker(event_log(spark, sf_dir), "log").check_null_values(threshold=10)
    return spark.createDataFrame([(c, x["null_count"], x["null_percentage"], x["passed"]) for c, x in found.items()], "column_name string, null_count long, null_percentage double, passed boolean")


@query(f"{_W_LOG} " + " UNION ALL ".join(_repeat_sql("log", subset, label) for subset, label in (("event_id", "event_id"), ("trip_id, status, event_ts", "trip_id, status, event_ts"), (", ".join(_LOG_ORDER), "all"))))
def checked_duplicates(spark, sf_dir):
    checker = dataset_checks.DataQualityChecker(event_log(spark, sf_dir), "log")
    found = [(", ".join(keys) if keys else "all", checker.check_duplicates(keys)) for keys in (["event_id"], ["trip_id", "status", "event_ts"], None)]
    return spark.createDataFrame([(k, x["duplicate_rows"], float(x["duplicate_percentage"]), x["total_rows"], x["passed"]) for k, x in found], "keys string, duplicate_rows long, duplicate_percentage double, total_rows long, passed boolean")


@query("SELECT * FROM (VALUES ('event_id', TRUE, 'INT', 'bigint', TRUE), ('status', TRUE, 'str', 'string', TRUE), ('fare_amount', TRUE, 'float64', 'double', TRUE), ('city_id', TRUE, 'string', 'int', FALSE), ('nowhere', FALSE, NULL, NULL, FALSE)) AS t(column_name, found, expected_type, actual_type, passed)")
def checked_types(spark, sf_dir):
    found = dataset_checks.DataQualityChecker(event_log(spark, sf_dir), "log").check_data_types(RULES["data_type_checks"])
    return spark.createDataFrame([(c, x.get("exists", True), x.get("expected_type"), x.get("actual_type"), x["passed"]) for c, x in found.items()], "column_name string, found boolean, expected_type string, actual_type string, passed boolean")


@query(f"{_W_LOG} " + _range_sql("log", *RULES["range_checks"][:3]))
def checked_ranges(spark, sf_dir):
    checker = dataset_checks.DataQualityChecker(event_log(spark, sf_dir), "log")
    found = [checker.check_value_range(**r) for r in RULES["range_checks"][:3]]
    return spark.createDataFrame([(x["column"], x["violations"], float(x["violation_percentage"]), x["passed"]) for x in found], "column_name string, violations long, violation_percentage double, passed boolean")


_OUTCOMES = f"nulls AS ({_null_sql('log', 15, *RULES['null_checks']['columns'])}), ranges AS ({_range_sql('log', *RULES['range_checks'][:3])}), repeats AS ({_repeat_sql('log', 'event_id', 'event_id')}), outcomes AS (SELECT passed FROM nulls UNION ALL SELECT passed FROM ranges UNION ALL SELECT passed FROM repeats UNION ALL SELECT * FROM (VALUES (TRUE), (TRUE), (TRUE), (FALSE), (FALSE)) AS types(passed))"


@query(f"{_W_LOG}, {_OUTCOMES} SELECT '' AS table_name, bool_and(passed) AS is_valid, count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round_even(100.0 * count(*) FILTER (WHERE passed) / count(*), 2) AS success_rate FROM outcomes")
def validated_dataset(spark, sf_dir):
    """All rules of a set in one job (Q7, C15); the rule on an unknown column counts neither way."""
    valid, found = dataset_checks.validate_dataset(event_log(spark, sf_dir), RULES)
    return spark.createDataFrame([(found["table_name"], valid, found["total_checks"], found["passed"], found["failed"], float(found["success_rate"]))], "table_name string, is_valid boolean, total_checks long, passed long, failed long, success_rate double")


@query(f"{_W_LOG}, n AS ({_null_sql('log', 0, 'status', 'driver_id')}), r AS ({_range_sql('log', RULES['range_checks'][1])}), outcomes AS (SELECT passed FROM n UNION ALL SELECT passed FROM r) SELECT 'log' AS table_name, count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round_even(100.0 * count(*) FILTER (WHERE passed) / count(*), 2) AS success_rate FROM outcomes")
def checker_summary(spark, sf_dir):
    """What a checker has gathered over several calls (Q1, Q6)."""
    checker = dataset_checks.DataQualityChecker(event_log(spark, sf_dir), "log")
    checker.check_null_values(["status", "driver_id"])
    checker.check_value_range("surge_multiplier", 1)
    checker.check_value_range("nowhere", 1)
    x = checker.get_summary()
    return spark.createDataFrame([(x["table_name"], x["total_checks"], x["passed"], x["failed"], float(x["success_rate"]))], "table_name string, total_checks long, passed long, failed long, success_rate double")


@query(f"{_W_LOG} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM log" for c in _LOG_ORDER))
def table_profile(spark, sf_dir):
    """Rows, columns and nulls of a table as its profile tells them."""
    found = profiles.data_profile(event_log(spark, sf_dir))
    return spark.createDataFrame([(c, found["rows"], found["null_counts"][c]) for c in found["column_names"]], "column_name string, rows long, null_count long")


# ---- sources and sinks: what is written is read back

_SUPPLIERS = "s_suppkey, s_name, s_nationkey, s_acctbal"


@query(f"SELECT {_SUPPLIERS}, CAST(NULL AS VARCHAR) AS s_comment FROM supplier")
def csv_read_back(spark, sf_dir):
    """CSV with a header and a stated schema whose last column the files lack."""
    rows, path = _read(spark, sf_dir, "supplier").select(*_SUPPLIERS.split(", ")), files.scratch_dir(spark, "csv")
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, path, T.StructType([*rows.schema.fields, T.StructField("s_comment", T.StringType())]))


@query(f"SELECT {_SUPPLIERS} FROM supplier")
def csv_read_by_name(spark, sf_dir):
    """CSV whose columns come in another order."""
    rows, path = _read(spark, sf_dir, "supplier").select(*_SUPPLIERS.split(", ")), files.scratch_dir(spark, "csv")
    rows.select(*reversed(rows.columns)).write.option("header", True).csv(path)
    return files.read_csv_by_name(spark, path, rows.schema)


@query(f"SELECT {_SUPPLIERS}, CAST(NULL AS INT) AS added_later FROM supplier")
def parquet_read_back(spark, sf_dir):
    """Partitioned Parquet that lacks a column of the schema."""
    rows, path = _read(spark, sf_dir, "supplier").select(*_SUPPLIERS.split(", ")), files.scratch_dir(spark, "parquet")
    if not files.write_parquet(rows, path, partition_by=["s_nationkey"]):
        raise RuntimeError(f"can't write {path}")
    return files.read_parquet(spark, path, T.StructType([*rows.schema.fields, T.StructField("added_later", T.IntegerType())]))


@query("SELECT 'STANDARD' AS storage_class, count(*) AS n, CAST(sum(1) AS BIGINT) AS with_size FROM (SELECT DISTINCT s_nationkey FROM supplier)")
def listed_objects(spark, sf_dir):
    """Objects of a folder with their sizes, the storage class from an inventory."""
    path = files.scratch_dir(spark, "listing")
    files.write_parquet(_read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey").repartition(1), path, partition_by=["s_nationkey"])
    listed = files.list_objects(spark, path).filter("key LIKE '%.parquet'")
    classed = listed.withColumn("storage_class", F.coalesce("storage_class", F.lit("STANDARD")))
    return classed.groupBy("storage_class").agg(F.count("*").alias("n"), F.count_if(F.col("size_bytes") > 0).alias("with_size"))


_SUPPLIER_UPSERT = f"SELECT {_SUPPLIERS} FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'renamed' AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0"


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.filter("s_suppkey % 3 = 0").withColumn("s_name", F.lit("renamed"))


@query(_SUPPLIER_UPSERT)
def versioned_upsert(spark, sf_dir):
    """A table in versions after two commits."""
    rows = _read(spark, sf_dir, "supplier").select(*_SUPPLIERS.split(", "))
    table = VersionedTable(spark, files.scratch_dir(spark, "versions"), rows.schema)
    table.create()
    table.commit(rows.filter("s_suppkey % 2 = 0"))
    table.update(lambda now: merge.upsert(now, merge.upsert(rows, _renamed(rows), ["s_suppkey"]), ["s_suppkey"]))
    return table.read()


@query(_SUPPLIER_UPSERT)
def bucketed_upsert(spark, sf_dir):
    """The same in buckets by key."""
    rows = _read(spark, sf_dir, "supplier").select(*_SUPPLIERS.split(", "))
    table = BucketedTable(spark, files.scratch_dir(spark, "buckets"), rows.schema, ["s_suppkey"], 4)
    table.upsert(rows)
    table.upsert(_renamed(rows))
    return table.read()
