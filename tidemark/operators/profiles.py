"""Profiles of tables and columns, each from one aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import percent


def _long(df: DataFrame, columns: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """Aggregate ``stats`` of every column in one pass, then one row per column."""
    wide = df.agg(F.count("*").alias("_rows"), *(f(c).alias(f"{c}\x00{name}") for c in columns for name, f in stats.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}\x00{name}`").alias(name) for name in stats)) for c in columns))
    return wide.select("_rows", F.inline(rows))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column and their share in percent, half-even to two places (A10)."""
    out = _long(df, list(columns or df.columns), {"null_count": lambda c: F.count_if(F.col(c).isNull())})
    return out.select("column_name", "null_count", F.bround(percent(F.col("null_count"), F.col("_rows")), 2).alias("null_percentage"))


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Rows per value, most first."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, nulls left out (A12); ``approximate`` for columns of unbounded variety."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return _long(df, columns, {"distinct_count": lambda c: count(F.col(c))}).drop("_rows")


def _quartile(x: Column, share: float, accuracy: int | None) -> Column:
    """Exact and linear, which holds every distinct value in one task, or of a rank at most 1/``accuracy`` of all rows away, in bounded memory."""
    return F.percentile(x, F.lit(share)) if accuracy is None else F.percentile_approx(x, share, accuracy).cast("double")


def _figures(x: Column, accuracy: int | None = None) -> list[Column]:
    return [
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"),
        *(_quartile(x, share, accuracy).alias(name) for name, share in QUARTILES.items()), F.max(x).cast("double").alias("max"),
    ]


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (linear), max of a numeric column."""
    return df.agg(*_figures(F.col(column), accuracy))


def describe_spread(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``describe`` with exact quartiles for columns of any variety: no task holds more than about 1/``parts`` of the distinct values.

    Approximate cuts part the values; counting the parts tells which hold the
    wanted ranks, and only these are ordered.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    n, cuts = x.agg(F.count("*"), F.percentile_approx("x", [i / parts for i in range(1, parts)], 50 * parts)).first()
    if not n:
        return describe(df, column)
    cuts = sorted(set(cuts))
    part = _part_of(F.col("x"), cuts, 0, len(cuts))
    counts = {r["part"]: r["n"] for r in x.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each part
    ranks = sorted({r for share in QUARTILES.values() for r in (math.floor(share * (n - 1)), math.ceil(share * (n - 1)))})
    wanted, before = [], 0
    for p in range(len(cuts) + 1):
        here = counts.get(p, 0)
        wanted += [(p, r, r - before) for r in ranks if before <= r < before + here]
        before += here
    held = x.select(part.alias("part"), "x").filter(F.col("part").isin([p for p, _, _ in wanted])).groupBy("part", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = held.withColumn("upto", upto)
    hits = [(F.col("part") == p) & (F.col("upto") > inside) & (F.col("upto") - F.col("n") <= inside) for p, _, inside in wanted]
    row = placed.agg(*(F.max(F.when(hit, F.col("x"))).alias(f"r{r}") for hit, (_, r, _) in zip(hits, wanted, strict=True))).first()

    def quartile(share: float) -> float:
        at = share * (n - 1)
        low, high = row[f"r{math.floor(at)}"], row[f"r{math.ceil(at)}"]
        return low + (high - low) * (at - math.floor(at))

    c = F.col(column)
    quartiles = [F.lit(quartile(share)).alias(name) for name, share in QUARTILES.items()]
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *quartiles, F.max(c).cast("double").alias("max"))


def _part_of(x: Column, cuts: list[float], low: int, high: int) -> Column:
    """The number of cuts at or below a value, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x < cuts[middle], _part_of(x, cuts, low, middle)).otherwise(_part_of(x, cuts, middle + 1, high))


def describe_group_sizes(df: DataFrame, key: str, accuracy: int | None = None) -> DataFrame:
    """The same over the number of rows per key."""
    return describe(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "n", accuracy)


def describe_all(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row per column: count, and for text distinct values, the most frequent one and its number; for numbers the figures of ``describe``.

    One aggregation for all numbers and one over all other columns, unpivoted.
    """
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    others = [c for c in df.columns if c not in numbers]
    parts = []
    if numbers:
        names = ["count", "mean", "std", "min", *QUARTILES, "max"]
        stats = {name: (lambda c, i=i: _figures(F.col(f"`{c}`").cast("double"), accuracy)[i]) for i, name in enumerate(names)}
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("unique", "long"), ("top", "string"), ("freq", "long"))]
        parts.append(_long(df, numbers, stats).select("column_name", "count", *nothing, *names[1:]))
    if others:
        entries = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in others))
        counts = df.select(F.inline(entries)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
        there = F.col("v").isNotNull()
        figures = [F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", *QUARTILES, "max")]
        parts.append(counts.groupBy("column_name").agg(
            F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("count"), F.count_if(there).alias("unique"),
            F.max_by("v", F.when(there, F.struct("n", "v"))).alias("top"), F.max(F.when(there, F.col("n"))).alias("freq"),
        ).select("column_name", "count", "unique", "top", "freq", *figures))
    return reduce(DataFrame.unionByName, parts)


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key; nulls are equal."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"))


def below_thresholds(df: DataFrame, column: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows below each threshold and their share of all rows."""
    wide = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(column) < t).alias(f"_t{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n")) for i, t in enumerate(thresholds)))
    return wide.select("_rows", F.inline(rows)).select("threshold", "n", F.bround(percent(F.col("n"), F.col("_rows")), 2).alias("percentage"))


def group_figures(df: DataFrame, key: str, column: str, accuracy: int | None = None) -> DataFrame:
    """Count, mean, median and sum per key; null keys are left out (A18). With ``accuracy`` a group of any size takes bounded memory."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), _quartile(F.col(column), 0.5, accuracy).alias("median"), F.sum(column).alias("total"))


def non_null_by_group(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-null values per key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.count(c).alias(c) for c in columns))


def spans_by_group(df: DataFrame, key: str, column: str, first: str, last: str) -> DataFrame:
    """Least and greatest value per key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias(first), F.max(column).alias(last))


def ordered_values(df: DataFrame, key: str, order: Sequence[str], column: str) -> DataFrame:
    """The values of each key in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, column)))
    return df.groupBy(key).agg(F.transform(rows, lambda x: x[column]).alias(f"{column}_sequence"))


def largest(df: DataFrame, column: str, tie: str, k: int) -> DataFrame:
    """The k rows with the greatest values (O3)."""
    return df.orderBy(F.desc_nulls_last(column), F.asc(tie)).limit(k)


def smallest(df: DataFrame, column: str, tie: str, k: int) -> DataFrame:
    """The k rows with the least values."""
    return df.orderBy(F.asc_nulls_last(column), F.asc(tie)).limit(k)


def peek(df: DataFrame, rows: int = 5) -> DataFrame:
    """Some rows of a table."""
    return df.limit(rows)


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def schema_text(df: DataFrame) -> str:
    """Names and types as a tree."""
    return df.schema.treeString()


def data_profile(df: DataFrame) -> dict:
    """Rows, columns, names, types and nulls of a table."""
    row = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first().asDict()
    rows = row.pop("_rows")
    return {"rows": rows, "columns": len(df.columns), "column_names": df.columns, "dtypes": dict(df.dtypes), "null_counts": row}
