import datetime as dt
import math
from decimal import Decimal

import pytest
from builders import at, log

from tidemark.operators import compare, profiles
from tidemark.plans import dataset_checks as Q
from tidemark.plans import event_quality as E
from tidemark.plans import reports

DAY = dt.date(2026, 5, 9)


def counts(df, *args):
    return {r.check_name: (r.failed_record_count, r.check_status) for r in E.summary(df, *args).collect()}


def test_summary(spark):
    d = Decimal
    rows = log(
        spark,
        (1, 1, "completed", "09 10:00", {"fare_amount": None}), (2, 2, "completed", "09 10:00", {"driver_id": None}),
        (3, 3, "requested", "09 10:00", {"fare_amount": d("-1")}), (4, 4, "requested", "09 10:00", {"fare_amount": d("10000")}), (5, 5, "requested", "09 10:00", {"fare_amount": d("10000.01")}),
        (6, 6, "requested", "09 10:00", {"pickup_lat": d("0"), "pickup_lng": d("0")}), (7, 7, "requested", "09 10:00", {"pickup_lat": d("90.000001")}), (8, 8, "requested", "09 10:00", {"pickup_lat": None}),
        (9, 9, "requested", "09 10:00", {"dropoff_lat": d("-91")}), (10, 10, "requested", "09 10:00", {"dropoff_lat": d("10")}),
        (11, 11, "requested", "09 10:00", {"ingested_at": at("09 09:00")}), (12, 12, "requested", "09 11:00"), (13, 12, "requested", "09 11:00"),
        (14, 13, "completed", "09 10:00"), (15, 13, "picked_up", "09 11:00"),
    )
    assert counts(rows, DAY) == {
        "EVENT_INGESTION_TIME_CONSISTENCY": (1, "FAILED"), "DAILY_EVENT_VOLUME": (0, "PASSED"), "COMPLETED_TRIP_NULL_FARE": (1, "FAILED"), "COMPLETED_TRIP_MISSING_DRIVER": (1, "FAILED"),
        "FARE_OUT_OF_ACCEPTED_RANGE": (2, "FAILED"), "INVALID_PICKUP_COORDINATES": (2, "FAILED"), "INVALID_DROPOFF_COORDINATES": (1, "FAILED"), "LOGICAL_DUPLICATE_EVENT": (1, "FAILED"), "STATUS_REGRESSION": (1, "FAILED"),
    }
    good, bad = E.quarantine_split(rows)
    assert sorted(r.event_id for r in bad.collect()) == [1, 3, 5, 6, 7, 9] and good.count() == 9
    flags = {(r.event_id, r.check_name) for r in E.flagged_rows(rows).collect()}
    assert (12, "LOGICAL_DUPLICATE_EVENT") in flags and (13, "LOGICAL_DUPLICATE_EVENT") in flags and (15, "STATUS_REGRESSION") in flags
    assert E.may_publish(E.summary(rows, DAY)) and not E.may_publish(E.summary(rows, dt.date(2020, 1, 1)))


def test_summary_of_nothing(spark):
    out = counts(log(spark).limit(0), DAY)
    assert out.pop("DAILY_EVENT_VOLUME") == (1, "FAILED") and set(out.values()) == {(0, "PASSED")}


def test_validate_dataset(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 5.0), (2, None, 5.0), (3, "b", None)], "id int, name string, x double")
    ok, s = Q.validate_dataset(df, {"null_checks": {"columns": ["id", "name"], "threshold": 50}, "duplicate_checks": {"subset": ["id"]}, "data_type_checks": {"id": "INT", "x": "float64", "gone": "int", "name": "int"}, "range_checks": [{"column": "x", "min_value": 1, "max_value": 5}, {"column": "x", "max_value": 4}, {"column": "none"}]})
    assert not ok and s["total_checks"] == 9 and s["failed"] == 4 and s["success_rate"] == 55.56 and s["table_name"] == ""
    assert Q.validate_dataset(df, {}) == (True, {"table_name": "", "total_checks": 0, "passed": 0, "failed": 0, "success_rate": 0, "checks_passed": [], "checks_failed": []})


def test_checker_details(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 5.0), (2, None, 5.0), (3, "b", None)], "id int, name string, x double")
    c = Q.DataQualityChecker(df, "t")
    assert c.check_null_values(["name"], 49.9)["name"] == {"null_count": 2, "null_percentage": 50.0, "passed": False}
    assert c.check_duplicates() == {"duplicate_rows": 1, "duplicate_percentage": 25.0, "total_rows": 4, "passed": False}
    assert c.check_value_range("x", 2)["violation_percentage"] == 33.33
    assert c.check_value_range("y") == {"error": "Column y not found"}
    assert c.check_data_types({"gone": "int"}) == {"gone": {"exists": False, "passed": False}}
    assert c.get_summary()["failed"] == 4
    with pytest.raises(Exception, match="nothing"):
        c.check_null_values(["nothing"])
    empty = Q.DataQualityChecker(df.limit(0))
    nulls = empty.check_null_values(["id"])["id"]
    assert math.isnan(nulls["null_percentage"]) and not nulls["passed"]
    assert empty.check_duplicates()["passed"] and empty.check_value_range("x", 1)["violation_percentage"] == 0


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None), (None, 5)], "k string, v int")
    assert [(r.k, r.n) for r in profiles.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert profiles.value_counts(df, "k", keep_null=True).count() == 3
    assert {r.column_name: r.distinct_count for r in profiles.distinct_counts(df, ["k", "v"]).collect()} == {"k": 2, "v": 3}
    d = profiles.describe(df, "v").first()
    assert (d["count"], d["mean"], d["min"], d["p50"], d["max"]) == (3, 3.0, 1.0, 3.0, 5.0)
    assert profiles.data_profile(df) == {"rows": 4, "columns": 2, "column_names": ["k", "v"], "dtypes": {"k": "string", "v": "int"}, "null_counts": {"k": 1, "v": 1}}
    assert profiles.null_profile(df.limit(0)).first()["null_percentage"] is None
    assert profiles.duplicate_count(spark.createDataFrame([(None,), (None,)], "a int")).first().duplicate_rows == 1
    assert {r.column_name: r["count"] for r in profiles.describe_all(df).collect()} == {"k": 3, "v": 3}


def test_inventory(spark):
    rows = [(f"x/event_date=2026-05-0{1 + i % 2}/part-{i}", i * 1024 * 1024, "STANDARD") for i in range(4)] + [("no date", 10, "STANDARD")]
    out = reports.inventory_report(spark.createDataFrame(rows, "key string, size_bytes long, storage_class string"))
    assert [(r.threshold, r.n, r.percentage) for r in out["small_files"].collect()][:2] == [(1.0, 2, 40.0), (16.0, 5, 100.0)]
    assert {r.event_date: (r.n, r.total) for r in out["partitions"].collect()} == {"2026-05-01": (2, 2.0), "2026-05-02": (2, 4.0)}
    assert out["largest"].first().key.endswith("part-3") and out["smallest"].first().key.endswith("part-0")


def test_snapshot_differences(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", 3)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5), (2, None, 2), (4, "w", 4)], "id int, s string, n int")
    out = reports.snapshot_report(a, b, "id", ["s", "n"])
    assert [tuple(r) for r in out["changes"].collect()] == [(1, "n", "1", "5")]
    assert [r.id for r in out["new"].collect()] == [4] and [r.id for r in out["removed"].collect()] == [3]
    assert tuple(out["totals"].first()) == (1, 1)
    assert compare.changed_rows(a, b, "id", ["s", "n"]).count() == 1 and compare.changed_rows(a, b, "id", ["s", "n"], null_is_change=True).count() == 2
    assert compare.same_columns(a, b) and not compare.same_columns(a, b.select("s", "id", "n"))


def test_event_report(spark):
    rows = log(spark, (1, 1, "requested", "09 23:50"), (2, 1, "completed", "10 00:10"), (3, 2, "requested", "09 10:00", {"pickup_lat": Decimal("0")}))
    out = reports.event_report(rows)
    assert [r.trip_id for r in out["midnight"].collect()] == [1] and out["zero_pickups"].count() == 1
    assert {r.trip_id: r.status_sequence for r in out["sequences"].collect()}[1] == ["requested", "completed"]
    assert out["delay"].first()["mean"] == 300.0


def test_rules_cost_one_job(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 5.0), (2, None, 5.0), (3, "b", None)], "id int, name string, x double")
    tracker, group = spark.sparkContext.statusTracker(), "one-job"
    spark.sparkContext.setJobGroup(group, "rules")
    try:
        Q.validate_dataset(df, {"null_checks": {}, "data_type_checks": {"id": "int"}, "range_checks": [{"column": "x", "min_value": i} for i in range(5)]})
        assert len(tracker.getJobIdsForGroup(group)) <= 2  # adaptive execution runs the partial aggregation as one
    finally:
        spark.sparkContext.setJobGroup("", "")
    ok, found = Q.validate_dataset(df, {"null_checks": {"columns": []}, "duplicate_checks": {}, "range_checks": []})
    assert not ok and found["total_checks"] == 1


def test_quartiles_of_any_spread(spark):
    import random

    rng = random.Random(2)
    for values in ([3.0], [1.0, 2.0], [rng.random() for _ in range(999)], [float(rng.randrange(5)) for _ in range(500)], [None, 4.0, 4.0, -1.5]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        a, b = profiles.describe(df, "v").first().asDict(), profiles.describe_spread(df, "v", 8).first().asDict()
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) or a[k] is None and b[k] is None for k in a)
    assert profiles.describe_spread(spark.createDataFrame([], "v double"), "v").first()["count"] == 0
    near = profiles.describe(spark.range(10_000), "id", accuracy=1000).first()
    assert abs(near["p50"] - 5000) <= 10 and profiles.group_figures(spark.range(100).selectExpr("id % 2 AS k", "id"), "k", "id", 100).count() == 2


def test_peek_shape_and_schema(spark):
    df = spark.range(9).selectExpr("id", "string(id) AS s")
    assert profiles.peek(df, 3).count() == 3 and profiles.shape(df) == (9, 2) and "s: string" in profiles.schema_text(df)


def test_either_zero(spark):
    rows = log(spark, (1, 1, "requested", "09 10:00", {"pickup_lat": Decimal("0")}), (2, 1, "requested", "09 10:01"), (3, 1, "requested", "09 10:02", {"pickup_lng": Decimal("181")}))
    assert [r.event_id for r in rows.filter(E.invalid_point("pickup_lat", "pickup_lng", either_zero=True)).orderBy("event_id").collect()] == [1, 3]
    assert [r.event_id for r in rows.filter(E.invalid_point("pickup_lat", "pickup_lng")).collect()] == [3]
