"""Keyed merges and differences of two tables, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    """A merge source holds a key more than once."""


def check_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise DuplicateKey(f"the source holds a key of {keys} more than once")


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows without a match, and all source rows; columns by name, missing ones null."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def matched(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows that a merge would update."""
    return target.join(source.select(*keys), keys, "left_semi")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """insert, update_preimage, update_postimage and delete rows that lead from old to new, in one join.

    Both sides are tagged and grouped by key: one shuffle each, no self-joins."""
    cols = [c for c in new.columns if c not in keys]
    pack = lambda df: df.select(*keys, F.struct(*(F.col(c) if c in df.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in cols)).alias("r"))
    both = pack(old).withColumnRenamed("r", "a").join(pack(new).withColumnRenamed("r", "b"), keys, "full")
    change = lambda kind, r: F.struct(F.lit(kind).alias("_change_type"), r.alias("r"))
    a, b = F.col("a"), F.col("b")
    rows = (
        F.when(a.isNull(), F.array(change("insert", b))).when(b.isNull(), F.array(change("delete", a)))
        .when(~a.eqNullSafe(b), F.array(change("update_preimage", a), change("update_postimage", b)))
    )
    return both.select(*keys, F.explode(rows).alias("x")).select(*keys, *(F.col(f"x.r.{c}").alias(c) for c in cols), "x._change_type")
