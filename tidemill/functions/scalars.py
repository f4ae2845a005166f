"""Expressions that the models and operators share. All are built-in functions underneath."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_MARK = "_null_"
#: Fixed value: what counts as an e-mail address.
EMAIL = "^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+$"


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean(c: Column | str) -> Column:
    """The average of an exact column, from its exact sum: the same whatever the order of rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def ladder(value: Column, steps: list[tuple[object, object]], other: object, above: bool = True) -> Column:
    """The label of the first step whose bound the value reaches (or, not ``above``, doesn't exceed)."""
    out = F
    for bound, label in steps:
        out = out.when(value >= bound if above else value <= bound, label)
    return out.otherwise(other)


def hash_key(*keys: str | Column) -> Column:
    """md5 of the business keys as text, joined by '|'; null if any key is null."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat(*(p for i, k in enumerate(parts) for p in ([F.lit("|")] if i else []) + [k])))


def hash_diff(*cols: str) -> Column:
    """md5 of attributes as text, a null counting as empty, joined by '|'."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


def surrogate_key(*cols: str) -> Column:
    return F.md5(F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in cols)))


def cents_to_dollars(c: str | Column) -> Column:
    return ((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)") / 100).cast("decimal(18,2)")


def date_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day from start to the day before end; none if end isn't later."""
    days = max(0, (end - start).days)
    return spark.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date_day"))


def month_start(c: str | Column) -> Column:
    return F.trunc(c, "month")


def months_apart(a: str | Column, b: str | Column) -> Column:
    """Whole months from a to b, both month starts."""
    return F.months_between(b, a).cast("int")


def date_parts(date: str) -> dict[str, Column]:
    d = F.col(date)
    return {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "day": F.dayofmonth(d), "day_of_week": F.weekday(d) + 1,
        "year_month": F.date_format(d, "yyyy-MM"), "year_quarter": F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
    }


def email_ok(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(EMAIL)


def lookup(value: str | Column, table: dict, other: object = None) -> Column:
    """The value's entry in a small table given as a dict, else ``other``."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c], F.lit(other))
