import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from builders import snapshot

from tidemark.functions.schemas import DIM_DRIVER
from tidemark.operators.merge import DuplicateSourceKey
from tidemark.plans import driver_history as D
from tidemark.plans import members as M

A = (1, "Ada", 34, "economy", "4.50", "active")


def dim(spark, *snapshots):
    out = spark.createDataFrame([], DIM_DRIVER)
    for s in snapshots:
        out = D.apply_snapshot(out, s)
    return out


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.driver_id, r.valid_from))


def test_first_snapshot(spark):
    r = rows(dim(spark, snapshot(spark, 8, A)))[0]
    assert r.driver_sk == hashlib.md5(b"1||2026-05-08").hexdigest().upper()
    assert r.scd2_hash == hashlib.md5(b"34||economy||active").hexdigest().upper()
    assert (r.valid_from, r.valid_to, r.is_current) == (dt.date(2026, 5, 8), dt.date(9999, 12, 31), True)


def test_type_2_and_type_1_together(spark):
    old, new = rows(dim(spark, snapshot(spark, 8, A), snapshot(spark, 9, (1, "Ada", 6, "economy", "4.60", "active"))))
    assert (old.rating, old.valid_to, old.is_current, old.city_id) == (Decimal("4.50"), dt.date(2026, 5, 8), False, 34)
    assert (new.rating, new.valid_from, new.is_current, new.city_id) == (Decimal("4.60"), dt.date(2026, 5, 9), True, 6)


def test_type_1_only_overwrites(spark):
    (r,) = rows(dim(spark, snapshot(spark, 8, A), snapshot(spark, 9, (1, "Ada L", 34, "economy", "4.60", "active"))))
    assert (r.driver_name, r.rating, r.valid_from) == ("Ada L", Decimal("4.60"), dt.date(2026, 5, 8))


def test_same_snapshot_twice_changes_nothing(spark):
    s = snapshot(spark, 8, A, (2, "Bo", 6, None, "4.00", "active"))
    assert rows(dim(spark, s)) == rows(dim(spark, s, s))


def test_dropped_driver_stays(spark):
    out = rows(dim(spark, snapshot(spark, 8, A, (2, "Bo", 6, "premium", "4.00", "active")), snapshot(spark, 9, A)))
    assert [r.is_current for r in out] == [True, True]


def test_classes(spark):
    before = dim(spark, snapshot(spark, 8, A, (2, "B", 6, "premium", "4.00", "active"), (3, "C", 6, "premium", "4.00", "active")))
    facts = spark.createDataFrame([(1, 5)], "trip_id long, driver_id long")
    after = snapshot(spark, 9, A, (2, "B", 6, "premium", "4.10", "active"), (3, "C", 6, "premium", "4.00", "suspended"), (4, "D", 6, "premium", "4.00", "active"), (5, "E", 6, "premium", "4.00", "active"))
    kinds = {r.driver_id: r.change_type for r in D.classify(after, M.add_inferred(before, facts)).collect()}
    assert kinds == {1: "UNCHANGED", 2: "SCD1_CHANGE", 3: "SCD2_CHANGE", 4: "NEW", 5: "INFERRED_RESOLUTION"}


def test_repeated_driver_raises(spark):
    with pytest.raises(DuplicateSourceKey):
        dim(spark, snapshot(spark, 8, A, A))


def test_stale_snapshot_guard(spark):
    now = dim(spark, snapshot(spark, 9, A))
    with pytest.raises(D.StaleSnapshot):
        D.apply_snapshot(now, snapshot(spark, 9, (1, "Ada", 6, "economy", "4.50", "active")), guard=True)


def test_early_fact_keeps_its_key(spark):
    now = dim(spark, snapshot(spark, 8, A))
    facts = spark.createDataFrame([(5200, 3050), (5201, None), (5202, 1)], "trip_id long, driver_id long")
    now = M.complete(now, facts)
    assert rows(M.complete(now, facts)) == rows(now)
    keys = {r.trip_id: r.resolved_driver_sk for r in M.resolve_keys(facts, now).collect()}
    assert keys[5200] == "INFERRED_DRIVER_3050" and keys[5201] == "UNKNOWN_DRIVER" and len(keys[5202]) == 32
    later = D.apply_snapshot(now, snapshot(spark, 9, A, (3050, "Late", 35, "comfort", "4.90", "active")))
    r = next(r for r in rows(later) if r.driver_id == 3050)
    assert (r.driver_sk, r.driver_name, r.valid_from, r.is_current) == ("INFERRED_DRIVER_3050", "Late", dt.date(1900, 1, 1), True)
    unknown = next(r for r in rows(later) if r.driver_id == -1)
    assert unknown.driver_sk == "UNKNOWN_DRIVER" and unknown.scd2_hash is None


def test_without_any_member_facts_are_unknown(spark):
    facts = spark.createDataFrame([(1, 9)], "trip_id long, driver_id long")
    assert M.resolve_keys(facts, dim(spark)).first().resolved_driver_sk == "UNKNOWN_DRIVER"


def test_null_in_hash(spark):
    r = rows(dim(spark, snapshot(spark, 8, (1, "A", None, None, "1.00", None))))[0]
    assert r.scd2_hash == hashlib.md5(b"<NULL>||<NULL>||<NULL>").hexdigest().upper()


def test_point_in_time(spark):
    hist = dim(spark, snapshot(spark, 8, A), snapshot(spark, 9, (1, "Ada", 6, "economy", "4.50", "active")))
    facts = spark.createDataFrame([(1, 1, dt.date(2026, 5, 8)), (2, 1, dt.date(2026, 5, 20)), (3, 1, dt.date(2020, 1, 1))], "trip_id long, driver_id long, d date")
    out = {r.trip_id: r.driver_sk for r in D.valid_on(hist, facts, "d").collect()}
    assert out[1] != out[2] and out[3] is None
