import datetime as dt
from decimal import Decimal

import pytest
from builders import at, log
from pyspark.sql import functions as F

from tidemark.functions.schemas import CURRENT_TRIPS
from tidemark.operators import latest, merge
from tidemark.plans import current_state as C
from tidemark.plans import trip_metrics as M

DAY = dt.date(2026, 5, 9)


def states(df):
    return {r.trip_id: r for r in df.collect()}


def full(spark, *extra):
    return log(
        spark,
        (1, 10, "requested", "09 10:00"), (2, 10, "driver_assigned", "09 10:01"), (3, 10, "picked_up", "09 10:03"), (4, 10, "completed", "09 10:20"),
        (5, 11, "requested", "09 11:00"), (6, 11, "completed", "09 11:30"), (7, 11, "picked_up", "09 11:40"),
        (8, 12, "requested", "08 23:52"), (9, 12, "completed", "09 00:14"),
        (10, 13, "picked_up", "09 12:00"), (11, 13, "completed", "09 12:10"),
        (12, 14, "requested", "09 13:00"), (13, 14, "odd status", "09 13:05"), (14, 14, None, "09 13:06"),
        (15, 15, "completed", "09 14:00"), (16, 15, "cancelled_by_rider", "09 14:05"),
        *extra,
    )


def test_current_rows(spark):
    out = states(C.build_current(full(spark), DAY))
    assert out[10].current_status == "completed" and out[10].latest_event_id == 4 and out[10].trip_date == DAY
    assert out[11].current_status == "completed"  # a later pick-up doesn't take a trip back
    assert out[12].trip_date == dt.date(2026, 5, 8)
    assert out[13].trip_date is None and out[13].current_status == "completed"
    assert out[14].current_status == "requested"
    assert out[15].current_status == "cancelled_by_rider"  # terminal states tie; the later one holds
    assert C.build_current(full(spark), DAY).columns == CURRENT_TRIPS.names


def test_duplicates_and_replays(spark):
    rows = log(
        spark,
        (1, 1, "requested", "09 10:00"), (2, 1, "requested", "09 10:00"),
        (3, 2, "completed", "09 11:00"), (3, 2, "completed", "09 11:00", {"fare_amount": Decimal("12.00"), "ingested_at": at("09 15:00")}),
    )
    out = states(C.build_current(rows, DAY))
    assert out[1].latest_event_id == 2 and out[2].fare_amount == Decimal("12.00")
    assert latest.duplicate_groups(rows).count() == 2 and latest.duplicate_members(rows).count() == 4


def test_late_event_reopens_the_whole_trip(spark):
    rows = log(spark, (1, 1, "requested", "01 10:00"), (2, 1, "completed", "01 10:30", {"ingested_at": at("09 08:00")}), (3, 2, "requested", "01 10:00"))
    out = states(C.build_current(rows, DAY))
    assert list(out) == [1] and out[1].current_status == "completed" and out[1].trip_date == dt.date(2026, 5, 1)


@pytest.mark.parametrize("ingested", ["07 00:00", "09 23:59"])
def test_window_is_closed_at_both_ends(spark, ingested):
    assert C.affected_trips(log(spark, (1, 1, "requested", "01 10:00", {"ingested_at": at(ingested)})), DAY).count() == 1


@pytest.mark.parametrize("ingested", ["06 23:59", "10 00:00"])
def test_outside_the_window(spark, ingested):
    assert C.affected_trips(log(spark, (1, 1, "requested", "01 10:00", {"ingested_at": at(ingested)})), DAY).count() == 0


def test_history_has_no_upper_bound_unless_asked(spark):
    rows = log(spark, (1, 1, "requested", "09 23:50"), (2, 1, "completed", "10 00:10"))
    assert states(C.build_current(rows, DAY))[1].current_status == "completed"
    assert states(C.build_current(rows, DAY, as_of=DAY))[1].current_status == "requested"


def test_upsert_twice_is_upsert_once_in_any_row_order(spark):
    empty = spark.createDataFrame([], CURRENT_TRIPS)
    once = C.apply_current(empty, full(spark), DAY)
    twice = C.apply_current(once, full(spark).orderBy("status", "event_id"), DAY)
    key = lambda r: r.trip_id
    assert sorted(once.collect(), key=key) == sorted(twice.collect(), key=key)


def test_merge_refuses_repeated_source_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(merge.DuplicateSourceKey):
        merge.upsert(a, a.union(a), ["k"])


def test_regressions(spark):
    rows = log(spark, (1, 1, "completed", "09 10:00"), (2, 1, "picked_up", "09 10:10"), (3, 1, "picked_up", "09 10:20"), (4, 2, "cancelled_by_rider", "09 10:00"), (5, 2, "requested", "09 10:10"))
    assert sorted(r.event_id for r in latest.regressions_from_highest(rows).collect()) == [2, 3, 5]
    assert [r.event_id for r in latest.regressions_from_previous(rows).collect()] == [2]


def test_metrics(spark):
    out = {r.trip_id: r for r in M.trip_metrics(full(spark), DAY).collect()}
    assert sorted(out) == [10, 11, 14]
    t = out[10]
    assert (t.time_to_assign_seconds, t.wait_to_pickup_seconds, t.trip_duration_seconds, t.total_trip_lifecycle_seconds, t.lifecycle_status) == (60, 120, 1020, 1200, "completed")
    assert out[14].lifecycle_status == "requested" and out[14].total_trip_lifecycle_seconds is None
    every = {r.trip_id: r for r in M.trip_metrics(full(spark)).collect()}
    assert every[13].trip_date is None and every[15].lifecycle_status == "completed"


def test_metrics_keep_nulls_at_the_last_completion(spark):
    rows = log(spark, (1, 1, "requested", "09 10:00"), (2, 1, "completed", "09 10:10"), (3, 1, "completed", "09 10:20", {"fare_amount": None, "driver_id": None}))
    out = M.trip_metrics(rows, DAY).first()
    assert out.fare_amount is None and out.driver_id == 3001


def test_empty_log(spark):
    empty = log(spark).limit(0)
    assert C.build_current(empty, DAY).count() == 0 and M.trip_metrics(empty, DAY).count() == 0


def test_regressions_of_replays_go_by_ingestion(spark):
    rows = log(spark, (1, 1, "completed", "09 10:00"), (2, 1, "picked_up", "09 10:10")).withColumn("ingested_at", F.lit(at("09 11:00")))
    replay = rows.filter("event_id = 2").withColumn("ingested_at", F.lit(at("09 12:00")))
    for both in (rows.unionByName(replay), replay.unionByName(rows)):
        assert [(r.event_id, r.ingested_at) for r in latest.regressions_from_previous(both.coalesce(1)).collect()] == [(2, at("09 11:00"))]


@pytest.mark.parametrize("name", ["status_regression_running_max", "status_regression_lag"])
def test_regression_queries_cover_events_with_replays(spark, name):
    from tidemark.queries import QUERIES

    found = [r.event_id for r in QUERIES[name](spark, "/root/testdata/sf0.01").select("event_id").collect()]
    assert any(i % 50 == 0 for i in found) and any(i % 50 for i in found)
