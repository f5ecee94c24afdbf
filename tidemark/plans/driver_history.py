"""Driver dimension with type 1 and type 2 attributes from daily snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import distinct_from, joined_key, upper_md5
from tidemark.functions.schemas import DIM_DRIVER, OPEN_END, SCD1_COLUMNS, SCD2_COLUMNS
from tidemark.operators.merge import insert_absent, require_unique, update_matched


class StaleSnapshot(ValueError):
    """A snapshot is not newer than the versions it would change."""


def with_hash(snapshot: DataFrame) -> DataFrame:
    """The snapshot with the hash of its type 2 attributes."""
    return snapshot.withColumn("snapshot_date", F.col("snapshot_date").cast("date")).withColumn("scd2_hash", upper_md5(joined_key(*SCD2_COLUMNS)))


def change_type(new: str, old: str) -> Column:
    """What a snapshot row (``new``) means for its current version (``old``); the first rule that holds wins."""

    def differs(c: str) -> Column:
        return distinct_from(F.col(new + c), F.col(old + c))

    return (
        F.when(F.col(f"{old}driver_id").isNull(), "NEW")
        .when(F.col(f"{old}driver_status") == "inferred", "INFERRED_RESOLUTION")
        .when(differs("scd2_hash"), "SCD2_CHANGE")
        .when(differs("driver_name") | differs("rating"), "SCD1_CHANGE")
        .otherwise("UNCHANGED")
    )


def classify(snapshot: DataFrame, dimension: DataFrame) -> DataFrame:
    """Each snapshot row with what it means for the current dimension."""
    now = dimension.filter("is_current").select(*(F.col(c).alias(f"_{c}") for c in ("driver_id", "driver_name", "rating", "driver_status", "scd2_hash")))
    s = with_hash(snapshot)
    return s.join(now, s["driver_id"] == now["_driver_id"], "left").select(*s.columns, change_type("", "_").alias("change_type"))


def resolve_inferred(dimension: DataFrame, changes: DataFrame) -> DataFrame:
    """Complete inferred members in place: key and validity stay (M2)."""
    values = {c: F.col(f"s.{c}") for c in ("driver_name", *SCD2_COLUMNS, "rating", "scd2_hash")}
    return update_matched(dimension, changes, ["driver_id"], F.col("t.is_current") & (F.col("s.change_type") == "INFERRED_RESOLUTION"), values, check=False)


def expire(dimension: DataFrame, changes: DataFrame) -> DataFrame:
    """Close the current version of drivers with a type 2 change the day before the snapshot (M3)."""
    values = {"valid_to": F.date_add(F.col("s.snapshot_date"), -1), "is_current": F.lit(False)}
    return update_matched(dimension, changes, ["driver_id"], F.col("t.is_current") & (F.col("s.change_type") == "SCD2_CHANGE"), values, check=False)


def new_versions(changes: DataFrame) -> DataFrame:
    """Rows to insert for new drivers and type 2 changes."""
    rows = changes.filter(F.col("change_type").isin("NEW", "SCD2_CHANGE"))
    return rows.select(
        upper_md5(joined_key("driver_id", "snapshot_date")).alias("driver_sk"), "driver_id", "driver_name", "city_id", "vehicle_type", "rating", "driver_status",
        F.col("snapshot_date").alias("valid_from"), F.lit(OPEN_END).alias("valid_to"), F.lit(True).alias("is_current"), "scd2_hash",
    )


def insert_versions(dimension: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert versions unless the driver has one from that day (M4)."""
    return insert_absent(dimension, new_versions(changes), ["driver_id", "valid_from"])


def overwrite_type1(dimension: DataFrame, changes: DataFrame) -> DataFrame:
    """Name and rating of the current version; history keeps its own (M5)."""
    differs = distinct_from(F.col("t.driver_name"), F.col("s.driver_name")) | distinct_from(F.col("t.rating"), F.col("s.rating"))
    return update_matched(dimension, changes, ["driver_id"], F.col("t.is_current") & differs, {c: F.col(f"s.{c}") for c in SCD1_COLUMNS}, check=False)


def reject_stale(dimension: DataFrame, changes: DataFrame) -> None:
    """Raise if a type 2 change isn't newer than the version it would close."""
    now = dimension.filter("is_current").select("driver_id", "valid_from")
    late = changes.filter("change_type = 'SCD2_CHANGE'").join(now, "driver_id").filter("snapshot_date <= valid_from")
    if found := late.select("driver_id", "snapshot_date").limit(1).collect():
        raise StaleSnapshot(f"driver {found[0]['driver_id']}: {found[0]['snapshot_date']} is not newer than the current version")


def apply_snapshot(dimension: DataFrame, snapshot: DataFrame, guard: bool = False, check: bool = True) -> DataFrame:
    """The next dimension (C7): what resolve_inferred, expire, insert_versions and overwrite_type1 give one after the other.

    Current versions and snapshot meet in one full join; each pair becomes the
    version as it is now, and the one that follows it if there is one. Closed
    versions pass by.
    """
    if check:
        require_unique(snapshot, ["driver_id"])
    if guard:
        reject_stale(dimension, classify(snapshot, dimension))
    s = with_hash(snapshot)
    fresh = s.select(F.lit(True).alias("n_given"), *(F.col(c).alias(f"n_{c}") for c in ("driver_id", "driver_name", *SCD2_COLUMNS, "rating", "snapshot_date", "scd2_hash")))
    now = dimension.filter("is_current").select(*(F.col(c).alias(f"o_{c}") for c in DIM_DRIVER.names))
    both = now.join(fresh, now["o_driver_id"] == fresh["n_driver_id"], "full").withColumn("kind", F.when(F.col("n_given"), change_type("n_", "o_")))
    resolved, closed = F.col("kind") == "INFERRED_RESOLUTION", F.col("kind") == "SCD2_CHANGE"
    renewed = {**dict.fromkeys(SCD1_COLUMNS, resolved | (F.col("kind") == "SCD1_CHANGE")), **dict.fromkeys((*SCD2_COLUMNS, "scd2_hash"), resolved)}
    version = {c: F.when(when, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c, when in renewed.items()}
    version["valid_to"] = F.when(closed, F.date_add("n_snapshot_date", -1)).otherwise(F.col("o_valid_to"))
    version["is_current"] = F.coalesce(~closed, F.lit(True))
    kinds = {f.name: f.dataType for f in dimension.schema}
    kept = F.when(F.col("o_driver_sk").isNotNull(), F.struct(*(version.get(c, F.col(f"o_{c}")).cast(kinds[c]).alias(c) for c in DIM_DRIVER.names)))
    following = {"driver_sk": upper_md5(joined_key("n_driver_id", "n_snapshot_date")), "valid_from": F.col("n_snapshot_date"), "valid_to": F.lit(OPEN_END), "is_current": F.lit(True)}
    added = F.when(F.col("kind").isin("NEW", "SCD2_CHANGE"), F.struct(*(following[c].cast(kinds[c]).alias(c) if c in following else F.col(f"n_{c}").cast(kinds[c]).alias(c) for c in DIM_DRIVER.names)))
    rows = both.select(F.explode(F.filter(F.array(F.struct(kept.alias("v"), F.lit(False).alias("added")), F.struct(added.alias("v"), F.lit(True).alias("added"))), lambda x: x["v"].isNotNull())).alias("x"))
    kept_rows = rows.filter(~F.col("x.added")).select("x.v.*").unionByName(dimension.filter("NOT coalesce(is_current, false)").select(*DIM_DRIVER.names))
    # a version of that day may be there already
    new_rows = rows.filter("x.added").select("x.v.*").join(dimension.select("driver_id", "valid_from"), ["driver_id", "valid_from"], "left_anti")
    return kept_rows.unionByName(new_rows.select(*DIM_DRIVER.names))


def valid_on(dimension: DataFrame, facts: DataFrame, date: str) -> DataFrame:
    """Facts with the version valid on their date (an extension: plain key resolution uses the current version)."""
    d = dimension.select(F.col("driver_id").alias("_id"), "driver_sk", "valid_from", "valid_to")
    on = (facts["driver_id"] == d["_id"]) & facts[date].between(d["valid_from"], d["valid_to"])
    return facts.join(d, on, "left").drop("_id", "valid_from", "valid_to")
