"""Slowly changing dimensions: insert-only (0), overwrite (1), versioned rows (2) and their view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import END_OF_TIME
from tidemill.functions.scalars import hash_diff, surrogate_key
from tidemill.operators.merge import check_unique, merge_rows


def scd0(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The first value of a key stays."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def scd1(target: DataFrame | None, source: DataFrame, keys: list[str], as_of: dt.datetime) -> DataFrame:
    source = source.withColumn("dw_updated_at", F.lit(as_of).cast("timestamp_ntz"))
    return source if target is None else merge_rows(target, source, keys)


def open_versions(source: DataFrame, tracked: list[str], as_of: dt.datetime) -> DataFrame:
    end = F.lit(END_OF_TIME).cast("timestamp_ntz")
    return source.withColumns({"_scd_hash": hash_diff(*tracked), "valid_from": F.lit(as_of).cast("timestamp_ntz"), "valid_to": end, "is_current": F.lit(True)})


def scd2(target: DataFrame | None, source: DataFrame, keys: list[str], tracked: list[str], as_of: dt.datetime) -> DataFrame:
    """The whole history after a load: a change in a tracked column (null-safe) closes the open version at
    ``as_of`` and opens a new one. Unchanged rows, and keys the source lacks, stay as they are. Running the
    same load twice changes nothing. A key twice in the source is an error."""
    check_unique(source, keys)
    if target is None:
        return open_versions(source, tracked, as_of)
    now, cols = F.lit(as_of).cast("timestamp_ntz"), target.columns
    new = source.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in source.columns if c not in keys), F.lit(1).alias("_in"))
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    current = target.where("is_current").join(new, keys, "left").withColumn("_changed", F.col("_in").isNotNull() & differs)
    kept = current.withColumns({"valid_to": F.when(F.col("_changed"), now).otherwise(F.col("valid_to")), "is_current": ~F.col("_changed")}).select(*cols)
    same = current.where("not _changed").select(*keys)
    opened = open_versions(source.join(same, keys, "left_anti"), tracked, as_of)
    return target.where("not is_current").unionByName(kept).unionByName(opened, allowMissingColumns=True)


def versions_view(history: DataFrame, key: str) -> DataFrame:
    """History with a key for each version."""
    return history.withColumn("customer_version_key" if key == "customer_id" else "version_key", surrogate_key(key, "valid_from"))
