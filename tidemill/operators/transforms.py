"""Transforms of a pipeline: plain functions for ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.merge import DuplicateKey

#: Bytes up to which a lookup is sent to all executors when asked for.
BROADCAST_BYTES = 64 << 20
_AGGREGATES: dict[str, Callable[[str], Column]] = {
    "SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MAX": F.max, "MIN": F.min, "COUNT_DISTINCT": F.count_distinct,
}
_WINDOWS = {"1 day": "0 days", "7 days": "4 days", "30 days": "0 days"}  # where windows begin: weeks on Monday


def dedup(keys: list[str], order_by: str, newest: bool = True, tie_break: list[str] | None = None):
    """One row per key: the newest (or oldest) by ``order_by``, null coming last; ties by the columns given, then by all
    others. Two aggregations instead of a sort of each key's rows: the first row of each key and moment, then the
    best moment of each key, both brought down before they are shuffled, so that a hot key fills no task."""

    def run(df: DataFrame) -> DataFrame:
        rest = [*(tie_break or []), *sorted(set(df.columns) - {order_by, *keys, *(tie_break or [])})]
        first = F.min(F.struct(F.lit(0).alias("_"), *(x for c in rest for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))))).alias("_row")
        moments = df.groupBy(*keys, order_by).agg(first)
        best = F.struct(order_by, "_row") if newest else F.struct(F.col(order_by).isNull().alias("_last"), order_by, "_row")
        best = moments.groupBy(*keys).agg((F.max if newest else F.min)(best).alias("_best"))
        place = lambda c: F.col(c) if c in keys else F.col(f"_best.{c}" if c == order_by else f"_best._row.{c}").alias(c)
        return best.select(*(place(c) for c in df.columns))

    return run


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def enrich(lookup: DataFrame | str, key: str | list[str], columns: list[str], broadcast: bool = False, check: bool = False):
    """LEFT lookup of some columns, from a frame or a table of the session's catalog. A hint to broadcast is followed only
    for a lookup of a bounded size."""
    keys = [key] if isinstance(key, str) else key

    def run(df: DataFrame) -> DataFrame:
        rows = df.sparkSession.table(lookup) if isinstance(lookup, str) else lookup
        side = rows.select(*keys, *(c for c in columns if c not in keys))
        if check and not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise DuplicateKey(f"the lookup holds a key of {keys} more than once")
        if broadcast and size_of(side) <= BROADCAST_BYTES:
            side = F.broadcast(side)
        return df.join(side, keys, "left")

    return run


def aggregate(keys: list[str], aggregates: list[tuple[str, str, str]], window: str | None = None, time: str = "event_date"):
    """Group by keys and, if given, a tumbling window of a time column. aggregates: (function, column, name)."""

    def run(df: DataFrame) -> DataFrame:
        by = [F.col(k) for k in keys]
        if window:
            by.append(F.window(time, window, window, _WINDOWS.get(window, "0 days")).alias("time_window"))
        out = df.groupBy(*by).agg(*(_AGGREGATES[f.upper()](c).alias(n) for f, c, n in aggregates))
        return out.withColumns({"window_start": F.col("time_window.start"), "window_end": F.col("time_window.end")}).drop("time_window") if window else out

    return run


def each_window(keys, aggregates, windows: list[str], time: str = "event_date"):
    """One result per window, by its length."""
    return {w: aggregate(keys, aggregates, w, time) for w in windows}


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def point_in_time(versions: DataFrame, key: str, at: str, valid_from: str = "valid_from", valid_to: str = "valid_to"):
    """The version of each key that holds at a time: valid_from <= at < valid_to. An equi join with a range
    on top, so it is dealt by key."""

    def run(df: DataFrame) -> DataFrame:
        v = versions.withColumnsRenamed({c: f"_v_{c}" for c in versions.columns})
        on = (F.col(key) == F.col(f"_v_{key}")) & (F.col(at) >= F.col(f"_v_{valid_from}")) & (F.col(at) < F.col(f"_v_{valid_to}"))
        return df.join(v, on, "left").drop(f"_v_{key}").withColumnsRenamed({f"_v_{c}": c for c in versions.columns if c not in df.columns})

    return run
