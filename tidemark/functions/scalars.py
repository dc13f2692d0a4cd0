"""Column expressions: parsing, coercion, labels. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The explicit date-time patterns that are tried, in order, as Spark patterns with
#: the shape that a value must have (Spark patterns alone accept trailing or missing digits).
DATETIME_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
]


def finite(column: Column) -> Column:
    """NaN and infinities become null: the rule at every boundary."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def to_number(column: Column, kind: str = "double") -> Column:
    """Numbers, or null where the text is none."""
    return finite(column.try_cast("double")) if kind == "double" else column.try_cast(kind)


def binary_label(column: Column) -> Column:
    """To a number, clipped to [0, 1], null as 0, then cut to a whole number: 0.5 is 0."""
    value = F.coalesce(F.greatest(F.least(to_number(column), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    return F.when(to_number(column).isNull(), F.lit(0)).otherwise(value).cast("byte")


def padded_day(column: Column) -> Column:
    """yyyymmdd as text or number, zero-padded on the left to eight digits; null if it is no date.

    Longer text is no date (padding would cut it to one), nor is one outside 1678 to 2261, the years
    of a 64-bit count of nanoseconds.
    """
    text = column.cast("string")
    day = F.to_date(F.try_to_timestamp(F.lpad(text, 8, "0"), F.lit("yyyyMMdd")))
    return F.when((F.length(text) <= 8) & F.year(day).between(1678, 2261), day)


def parsed(column: Column, pattern: str, shape: str) -> Column:
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))


def epoch(column: Column, digits: int) -> Column:
    """10-digit seconds or 13-digit milliseconds, of the years 2000 to 2100."""
    text = F.trim(column.cast("string"))
    number = F.when(text.rlike(rf"^\d{{{digits}}}$"), text.try_cast("long"))
    when = F.timestamp_seconds(number) if digits == 10 else F.timestamp_millis(number)
    return F.when(F.year(when).between(2000, 2100), when)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(F.to_date(later), F.to_date(earlier))


def horizon_label(days_to_failure: Column, horizon: int) -> Column:
    """1 where the failure is within 0 to ``horizon`` days, else 0 (null: 0)."""
    return F.when(days_to_failure.between(0, horizon), 1).otherwise(0).cast("byte")


def log1p_clamped(column: Column) -> Column:
    """log1p of the value or of 0 if it is negative; null for null, NaN and infinities."""
    value = finite(column)
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def month_text(column: Column) -> Column:
    return F.date_format(column, "MM")


def key_digest(*columns: Column, sep: str = "|") -> Column:
    """MD5 of the columns' text, which no null is part of (null if any is)."""
    joined = columns[0].cast("string")
    for c in columns[1:]:
        joined = F.concat(joined, F.lit(sep), c.cast("string"))
    return F.md5(F.encode(joined, "UTF-8"))
