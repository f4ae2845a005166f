"""Hubs, links and satellites. Loads append what isn't there yet, by left anti joins on hash keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import hash_diff, hash_key


def _earliest(df: DataFrame, key: str) -> DataFrame:
    """One row per hash key, that of the earliest load date; partial sums keep the shuffle small."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct("load_date", *(c for c in rest if c != "load_date"))).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def hub(source: DataFrame, name: str, key: str, record_source: str, load_date: str = "load_date") -> DataFrame:
    df = source.where(F.col(key).isNotNull()).select(hash_key(key).alias(f"{name}_hk"), F.col(key).alias(f"{name}_bk"), F.col(load_date).alias("load_date"), F.lit(record_source).alias("record_source"))
    return _earliest(df, f"{name}_hk")


def link(source: DataFrame, name: str, ends: dict[str, str], record_source: str, load_date: str = "load_date") -> DataFrame:
    """ends: hub name -> key column. The link's key is the hash of all business keys."""
    df = source
    for c in ends.values():
        df = df.where(F.col(c).isNotNull())
    cols = [F.col(c).alias(f"{h}_bk") for h, c in ends.items()]
    df = df.select(hash_key(*ends.values()).alias(f"{name}_hk"), *(hash_key(c).alias(f"{h}_hk") for h, c in ends.items()), *cols, F.col(load_date).alias("load_date"), F.lit(record_source).alias("record_source"))
    return _earliest(df, f"{name}_hk")


def satellite(source: DataFrame, name: str, key: str, attributes: list[str], record_source: str, load_date: str = "load_date") -> DataFrame:
    df = source.where(F.col(key).isNotNull()).select(hash_key(key).alias(f"{name}_hk"), *attributes, hash_diff(*attributes).alias("hash_diff"), F.col(load_date).alias("load_date"), F.lit(record_source).alias("record_source"))
    return df.dropDuplicates([f"{name}_hk", "hash_diff"])


def unseen(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(target.select(*keys), keys, "left_anti")
