"""Column expressions with the semantics the plans rely on; all run inside the JVM."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.schemas import NULL_MARK, SEPARATOR, STATUS_PRECEDENCE


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def status_precedence(status: Column | str = "status", order: Mapping[str, int] = STATUS_PRECEDENCE) -> Column:
    """Precedence of a status; unknown and null ones are 0 (P10)."""
    out = F.lit(0)
    for value in sorted(set(order.values())):
        out = F.when(_col(status).isin([k for k, v in order.items() if v == value]), value).otherwise(out)
    return out


def mapped(column: Column | str, values: Mapping[str, int]) -> Column:
    """Value of a key, null where there is none."""
    out = F.lit(None).cast("int")
    for key, value in values.items():
        out = F.when(_col(column) == key, value).otherwise(out)
    return out


def joined_key(*columns: Column | str) -> Column:
    """The columns as text with a separator, nulls as a marker."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(SEPARATOR), F.coalesce(_col(c).cast("string"), F.lit(NULL_MARK))]
    return F.concat(*parts[1:])


def upper_md5(text: Column) -> Column:
    """Uppercase MD5 of a text's UTF-8 bytes."""
    return F.upper(F.md5(text))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Whole elapsed seconds, towards zero."""
    return F.timestamp_diff("SECOND", _col(a), _col(b))


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent as a double; null for an empty whole (F16)."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def outside(column: Column | str, low, high) -> Column:
    """Whether a value lies outside a closed range; null for null."""
    return ~_col(column).between(F.lit(low), F.lit(high))


def first_group(column: Column | str, pattern: str) -> Column:
    """First group of a pattern, null without a match."""
    return F.nullif(F.regexp_extract(_col(column), pattern, 1), F.lit(""))


def distinct_from(a: Column, b: Column) -> Column:
    """Inequality for which nulls are equal."""
    return ~a.eqNullSafe(b)


def on_days(column: Column | str, first: dt.date, last: dt.date) -> Column:
    """Whether a time lies on one of the days, both included; bounds on the bare column, so that scans can skip by them (P5, F1)."""
    return (_col(column) >= F.lit(first)) & (_col(column) < F.lit(last + dt.timedelta(days=1)))


def parsed_time(column: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A text as a zone-free time; an error for what doesn't fit."""
    return F.to_timestamp_ntz(_col(column), F.lit(pattern))
