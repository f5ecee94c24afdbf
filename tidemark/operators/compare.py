"""Set operations and differences of two snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import distinct_from


def new_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return after.select(key).distinct().join(before.select(key), key, "left_anti")


def removed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return new_keys(after, before, key)


def common_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.select(key).distinct().join(after.select(key), key, "left_semi")


def side_by_side(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], suffixes: tuple[str, str] = ("_day1", "_day2")) -> DataFrame:
    """Inner join of two snapshots, each column with its day's suffix."""
    a = before.select(key, *(F.col(c).alias(c + suffixes[0]) for c in columns))
    return a.join(after.select(key, *(F.col(c).alias(c + suffixes[1]) for c in columns)), key)


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], null_is_change: bool = False) -> DataFrame:
    """Rows with any change (P17); by default nulls are equal to each other, else two nulls differ as NaN does."""
    both = side_by_side(before, after, key, columns)

    def differs(c: str):
        a, b = F.col(c + "_day1"), F.col(c + "_day2")
        return F.coalesce(a != b, F.lit(True)) if null_is_change else distinct_from(a, b)

    return both.filter(reduce(lambda x, y: x | y, (differs(c) for c in columns)))


def change_log(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per changed value: key, attribute, old and new value as text."""
    both = side_by_side(before, after, key, columns)
    entries = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c + "_day1").cast("string").alias("old_value"), F.col(c + "_day2").cast("string").alias("new_value"), distinct_from(F.col(c + "_day1"), F.col(c + "_day2")).alias("changed")) for c in columns))
    return both.select(key, F.inline(F.filter(entries, lambda e: e["changed"]))).drop("changed")


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Equal names in equal order (P20)."""
    return a.columns == b.columns
