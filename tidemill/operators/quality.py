"""Rules with a quarantine, and data tests that return the rows that fail."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import email_ok

WARNING, ERROR, CRITICAL = "WARNING", "ERROR", "CRITICAL"


class CriticalViolation(ValueError):
    """A rule that must hold for the load to go on has violators."""


@dataclass(frozen=True)
class Rule:
    """``violated`` is a condition on a row; unknown counts as violated."""

    name: str
    description: str
    violated: Column
    severity: str = ERROR

    @property
    def holds_not(self) -> Column:
        return F.coalesce(self.violated, F.lit(True))

    @classmethod
    def sql(cls, name: str, violation: str, description: str = "", severity: str = ERROR) -> Rule:
        return cls(name, description or violation, F.expr(violation), severity)


def not_null(c: str, severity: str = ERROR) -> Rule:
    return Rule(f"{c}_not_null", f"{c} must be set", F.col(c).isNull(), severity)


def positive(c: str, severity: str = ERROR) -> Rule:
    return Rule(f"{c}_positive", f"{c} must be above zero", F.col(c) <= 0, severity)


def valid_email(c: str, severity: str = WARNING) -> Rule:
    return Rule(f"{c}_email", f"{c} must be an address", ~email_ok(c), severity)


def date_range(c: str, lo: dt.date, hi: dt.date, severity: str = ERROR) -> Rule:
    return Rule(f"{c}_range", f"{c} must lie in {lo} to {hi}", ~F.col(c).between(F.lit(lo), F.lit(hi)), severity)


def split(df: DataFrame, rules: list[Rule], customer: str = "", table: str = "", pipeline: str = "", at: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) from one pass: a row belongs to the first ERROR or CRITICAL rule it violates.
    WARNING violations stay valid and are listed in ``_warnings``."""
    hard = [r for r in rules if r.severity != WARNING]
    owner = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(hard))):
        owner = F.when(r.holds_not, F.lit(i)).otherwise(owner)
    soft = F.array_compact(F.array(*(F.when(r.holds_not, F.lit(r.name)) for r in rules if r.severity == WARNING))) if len(hard) < len(rules) else F.array().cast("array<string>")
    tagged = df.withColumns({"_owner": owner, "_warnings": soft})
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("_owner") + 1) if values else F.lit(None).cast("string")
    when = F.lit(at or dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    bad = tagged.where("_owner is not null").withColumns({
        "_quarantine_rule": pick([r.name for r in hard]), "_quarantine_reason": pick([r.description for r in hard]), "_quarantine_severity": pick([r.severity for r in hard]),
        "_quarantine_customer": F.lit(customer), "_quarantine_table": F.lit(table), "_quarantine_pipeline": F.lit(pipeline), "_quarantine_timestamp": when,
    }).drop("_owner", "_warnings")
    return tagged.where("_owner is null").drop("_owner"), bad


def referential(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key is set and has no parent."""
    p = parent.select(F.col(parent_key or key).alias(key))
    return df.where(F.col(key).isNotNull()).join(p, key, "left_anti")


class Quarantine:
    """Quarantined rows by customer, table and, if wanted, date."""

    def __init__(self, path: str, by_date: bool = True):
        self.path, self.by_date = path.rstrip("/"), by_date

    def write(self, bad: DataFrame, batch: str = "none") -> None:
        """Rows of a named batch replace those that an earlier attempt at it has written; unnamed ones are appended."""
        df = bad.withColumns({"customer": F.col("_quarantine_customer"), "table": F.col("_quarantine_table")})
        by = ["customer", "table"]
        if self.by_date:
            df, by = df.withColumn("date", F.to_date("_quarantine_timestamp")), [*by, "date"]
        df.write.mode("append" if batch == "none" else "overwrite").partitionBy(*by).parquet(f"{self.path}/batch={batch}")

    def read(self, spark, customer: str, table: str) -> DataFrame:
        df = spark.read.option("mergeSchema", "true").option("basePath", self.path).parquet(self.path)
        return df.where((F.col("customer") == customer) & (F.col("table") == table)).drop("batch")


# ---- data tests: each returns the rows that fail --------------------------------------------------


def unique(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def accepted(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(values)).groupBy(col).agg(F.count("*").alias("n"))


def out_of_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(col) < F.lit(lo))
    if hi is not None:
        bad = bad | (F.col(col) > F.lit(hi))
    return df.where(bad)


def expression(df: DataFrame, condition: str) -> DataFrame:
    return df.where(~F.expr(condition))


def one_hash_per_key(df: DataFrame, key: str, hk: str) -> DataFrame:
    """Business keys with more than one hash key."""
    return df.groupBy(key).agg(F.count_distinct(hk).alias("n")).where("n > 1")


def descriptive_columns(hub_df: DataFrame, name: str) -> list[str]:
    """Columns a hub must not have."""
    return [c for c in hub_df.columns if c not in {f"{name}_hk", f"{name}_bk", "load_date", "record_source"}]


# ---- tests of a vault ------------------------------------------------------------------------------


def orphans(hub_df: DataFrame, name: str, links: list[DataFrame]) -> DataFrame:
    """Hub keys that no link refers to."""
    out = hub_df.select(f"{name}_hk")
    for link_df in links:
        out = out.join(link_df.select(f"{name}_hk"), f"{name}_hk", "left_anti")
    return out


def broken_links(link_df: DataFrame, hubs: dict[str, DataFrame]) -> DataFrame:
    """(end, n): links whose key of a hub isn't in it."""
    out = None
    for name, hub_df in hubs.items():
        bad = link_df.join(hub_df.select(f"{name}_hk"), f"{name}_hk", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("end"), "n")
        out = bad if out is None else out.unionByName(bad)
    return out.where("n > 0")


def repeated_states(sat_df: DataFrame, name: str) -> DataFrame:
    """States (key and hash of all attributes) that a satellite holds more than once."""
    return unique(sat_df, f"{name}_hk", "hash_diff")


def hash_length(df: DataFrame, column: str, length: int = 32) -> DataFrame:
    """Rows whose hash is missing or hasn't the length of an md5."""
    return df.where(F.coalesce(F.length(column) != length, F.lit(True)))


def positive_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is set and not above zero."""
    return df.where(F.col(column) <= 0)
