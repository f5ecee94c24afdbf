import datetime as dt

import pytest
from builders import log

import tidemark.plans.session as session
from tidemark.functions.schemas import CURRENT_TRIPS, OBJECT_INVENTORY, TRIP_EVENTS
from tidemark.plans import current_state
from tidemark.sources import files
from tidemark.operators.merge import DuplicateSourceKey
from tidemark.sources.versioned import BucketedTable, VersionedTable, compact
from tidemark.streaming import events


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("key,size_bytes,storage_class,last_modified\r\nk1,5,STANDARD,2026-05-08 10:00:00\r\nk2,,STANDARD,\r\n", newline="")
    rows = files.read_csv(spark, str(path), OBJECT_INVENTORY).collect()
    assert [tuple(r) for r in rows] == [("k1", 5, "STANDARD", dt.datetime(2026, 5, 8, 10)), ("k2", None, "STANDARD", None)]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), OBJECT_INVENTORY) is None
    assert files.read_parquet(spark, str(tmp_path / "none")) is None


def test_csv_columns_by_name_and_old_files(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("size_bytes,key\n7,k\n")
    assert tuple(files.read_csv_by_name(spark, str(path), OBJECT_INVENTORY).first()) == ("k", 7, None, None)
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(path), OBJECT_INVENTORY, check_header=True).collect()


def test_parquet_and_listing(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "size_bytes")
    assert files.write_parquet(df, str(tmp_path / "p"), files=1)
    assert files.read_parquet(spark, str(tmp_path / "p"), OBJECT_INVENTORY).select("size_bytes", "key").count() == 5
    listed = files.list_objects(spark, str(tmp_path / "p")).collect()
    assert sum(r.key.endswith(".parquet") for r in listed) == 1
    assert files.schema_drift(df, OBJECT_INVENTORY)["missing"] == ["key", "storage_class", "last_modified"]
    assert files.upload_file(spark, listed[0].key.removeprefix("file:"), f"file://{tmp_path}", "copy") and (tmp_path / "copy").exists()
    assert not files.download_file(spark, f"file://{tmp_path}", "absent", str(tmp_path / "x"))


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", OBJECT_INVENTORY)
    t.create()
    t.create()
    assert t.version() == 0 and t.read().count() == 0
    t.update(lambda now: now.unionByName(files.with_schema(spark.range(3).withColumnRenamed("id", "size_bytes"), OBJECT_INVENTORY)))
    t.update(lambda now: now.filter("size_bytes > 0"))
    assert t.version() == 2 and t.read().count() == 2 and t.read(1).count() == 3
    t.drop_old(1)
    assert not (tmp_path / "t" / "v=1").exists() and t.read().count() == 2
    assert compact(t.read(), 10 * 1024**3).rdd.getNumPartitions() == 40


def test_stream_rebuilds_trips(spark, tmp_path):
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/current"
    log(spark, (1, 1, "requested", "09 10:00"), (2, 2, "requested", "09 10:00")).write.parquet(source)
    table = VersionedTable(spark, path, CURRENT_TRIPS)
    table.create()

    def run():
        stream = events.without_replays(events.event_stream(spark, source))
        events.maintain(stream, table, lambda: spark.read.schema(TRIP_EVENTS).parquet(source), str(tmp_path / "check")).awaitTermination(120)

    run()
    log(spark, (3, 1, "completed", "09 10:30")).write.mode("append").parquet(source)
    run()
    assert {r.trip_id: r.current_status for r in table.read().collect()} == {1: "completed", 2: "requested"}
    whole = current_state.current_rows(current_state.logical_events(spark.read.schema(TRIP_EVENTS).parquet(source)))
    assert sorted(whole.collect()) == sorted(table.read().collect())


def test_settings(monkeypatch):
    monkeypatch.setenv("AWS_REGION", "eu-north-1")
    monkeypatch.setenv("HERE_DATA_RAW_PATH", "/raw")
    names = "aws_region aws_account_id s3_bucket_raw s3_bucket_processed s3_bucket_analytics data_raw_path data_processed_path redshift_host redshift_database".split()
    assert list(session.get_config()) == names and session.get_config()["aws_region"] == "eu-north-1"
    assert session.get_config("HERE_")["data_raw_path"] == "/raw" and session.get_config("HERE_")["aws_region"] == "us-east-1"


def test_listing_by_prefix_and_errors(spark, tmp_path):
    for key in ("a/x.txt", "a/y.txt", "ab/z.txt", "c.txt"):
        (tmp_path / key).parent.mkdir(exist_ok=True)
        (tmp_path / key).write_text("x")
    root = f"file://{tmp_path}"
    assert files.list_files(spark, root) == ["a/x.txt", "a/y.txt", "ab/z.txt", "c.txt"]
    assert files.list_files(spark, root, "a/") == ["a/x.txt", "a/y.txt"] and files.list_files(spark, str(tmp_path), "a") == ["a/x.txt", "a/y.txt", "ab/z.txt"]
    assert files.list_files(spark, root + "/none") == [] and files.list_objects(spark, root + "/none").columns == OBJECT_INVENTORY.names
    assert files.list_objects(spark, root).first().storage_class is None
    assert files.download_file(spark, root, "a/x.txt", str(tmp_path / "copied")) and (tmp_path / "copied").read_text() == "x"


def test_bucketed_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "k long, v string"
    t = BucketedTable(spark, f"file://{tmp_path}/b", spark.createDataFrame([], schema).schema, ["k"], 8)
    assert t.read().count() == 0 and t.upsert(spark.createDataFrame([], schema)) == 0
    t.upsert(spark.createDataFrame([(i, "old") for i in range(100)] + [(None, "null key")], schema))
    before = t.buckets()
    t.upsert(spark.createDataFrame([(3, "new"), (200, "added")], schema))
    after = t.buckets()
    assert 1 <= sum(before.get(b) != v for b, v in after.items()) <= 2
    rows = {r.k: r.v for r in t.read().collect()}
    assert len(rows) == 102 and rows[3] == "new" and rows[200] == "added" and rows[4] == "old" and t.read().count() == 102
    with pytest.raises(DuplicateSourceKey):
        t.upsert(spark.createDataFrame([(1, "a"), (1, "b")], schema))
    assert {r.k: r.v for r in t.read().collect()} == rows
