"""Unknown and inferred dimension members, and fact keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schemas import DIM_DRIVER, INFERRED_PREFIX, OPEN_END, UNKNOWN_ID, UNKNOWN_KEY, UNKNOWN_START
from tidemark.operators.merge import insert_absent


def _member(rows: DataFrame, key, driver_id, name: str, status: str, like: DataFrame | None = None) -> DataFrame:
    kinds = {f.name: f.dataType for f in (like.schema if like is not None else DIM_DRIVER)}
    given = {"driver_sk": key, "driver_id": driver_id, "driver_name": F.lit(name), "driver_status": F.lit(status), "valid_from": F.lit(UNKNOWN_START), "valid_to": F.lit(OPEN_END), "is_current": F.lit(True)}
    return rows.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in DIM_DRIVER.names))


def add_unknown(dimension: DataFrame) -> DataFrame:
    """The one member for facts without a driver, inserted once (M6)."""
    one = _member(dimension.sparkSession.range(1), F.lit(UNKNOWN_KEY), F.lit(UNKNOWN_ID), "Unknown Driver", "unknown", dimension)
    return insert_absent(dimension, one, ["driver_sk"])


def missing_members(trips: DataFrame, dimension: DataFrame) -> DataFrame:
    """Driver ids of trips without a current member (J5); the anti-join runs on distinct ids."""
    ids = trips.filter(F.col("driver_id").isNotNull()).select("driver_id").distinct()
    return ids.join(dimension.filter("is_current").select("driver_id"), "driver_id", "left_anti")


def inferred_members(missing: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """A placeholder per missing driver, its key made from the id."""
    return _member(missing, F.concat(F.lit(INFERRED_PREFIX), F.col("driver_id").cast("string")), F.col("driver_id"), "Inferred Driver", "inferred", dimension)


def add_inferred(dimension: DataFrame, trips: DataFrame) -> DataFrame:
    """Insert placeholders unless a current member exists (M7)."""
    return insert_absent(dimension, inferred_members(missing_members(trips, dimension), dimension), ["driver_id"], F.col("is_current"))


def complete(dimension: DataFrame, trips: DataFrame) -> DataFrame:
    """Unknown and inferred members added."""
    return add_inferred(add_unknown(dimension), trips)


def resolve_keys(trips: DataFrame, dimension: DataFrame) -> DataFrame:
    """Each trip with the key of its driver's current version, or the unknown one."""
    now = dimension.filter("is_current").select("driver_id", "driver_sk")
    return trips.select("trip_id", "driver_id").join(now, "driver_id", "left").select("trip_id", "driver_id", F.coalesce("driver_sk", F.lit(UNKNOWN_KEY)).alias("resolved_driver_sk"))
