"""Merges as functions from tables to the next table (M1-M7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateSourceKey(ValueError):
    """A merge source has more than one row for a key."""


def require_unique(source: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key of a merge source repeats; stops at the first such key."""
    twice = source.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicateSourceKey(f"source key {twice[0].asDict()} occurs {twice[0]['count']} times")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Source rows replace target rows of equal key; other rows of both stay (M1)."""
    if check:
        require_unique(source, keys)
    return target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def update_matched(target: DataFrame, source: DataFrame, keys: Sequence[str], when: Column, values: Mapping[str, Column], check: bool = True) -> DataFrame:
    """Set ``values`` on target rows (``t``) that match a source row (``s``) of equal key and meet ``when`` (M2, M3, M5)."""
    if check:
        require_unique(source, keys)
    t, s = target.alias("t"), source.withColumn("_matched", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    hit = F.coalesce(F.col("s._matched") & when, F.lit(False))
    return t.join(s, on, "left").select(*(F.when(hit, values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}").alias(c) for c in target.columns))


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], among: Column | None = None) -> DataFrame:
    """Add the rows whose key no target row (meeting ``among``) has (M4, M6, M7)."""
    there = target if among is None else target.filter(among)
    return target.unionByName(rows.join(there.select(*keys), list(keys), "left_anti").select(*target.columns))
