"""Extraction strategies. Each returns the new rows and the cursor to commit once they are loaded.

A strategy never stores its cursor itself: the pipeline does, after the target has been written, so a
load that fails is extracted again. "Nothing new" is an empty frame of the source's schema.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.config import Tenant
from tidemill.metrics import Metrics
from tidemill.sources.versioned import VersionedTable
from tidemill.state import Cursor

#: Types of a CDC record by its code; others pass through.
OPERATIONS = {"c": "insert", "u": "update", "d": "delete"}


@dataclass
class Context:
    spark: SparkSession
    tenant: Tenant
    table: str
    options: dict = field(default_factory=dict)
    cursor: Cursor | None = None
    now: dt.datetime = dt.datetime(1970, 1, 1)
    metrics: Metrics = field(default_factory=Metrics)

    @property
    def last(self) -> str | None:
        return self.cursor.watermark if self.cursor else None

    def source(self) -> DataFrame:
        """The source table: a frame or a path in the options, or a JDBC table."""
        o = self.options
        if "frame" in o:
            return o["frame"]
        if "path" in o:
            return self.spark.read.format(o.get("format", "parquet")).load(o["path"])
        read = self.spark.read.format("jdbc").options(**self.tenant.options, fetchsize=self.tenant.batch_size)
        if "partition_column" in o:  # read in parallel only with all four options
            read = read.options(partitionColumn=o["partition_column"], lowerBound=o.get("lower_bound", 0), upperBound=o.get("upper_bound", 1_000_000), numPartitions=o.get("partitions", self.tenant.parallelism))
        return read.option("dbtable", f"{self.tenant.schema}.{self.table}" if self.tenant.schema else self.table).load()

    def done(self, strategy: str, df: DataFrame, watermark: str | None, **more) -> tuple[DataFrame, Cursor]:
        return df, Cursor(self.tenant.customer_id, self.table, strategy, watermark, 0, "SUCCESS", self.now.isoformat(), more)


def full_reload(c: Context):
    """The whole table, once; again only if forced or the last run failed."""
    df = c.source()
    done = c.cursor is not None and c.cursor.status == "SUCCESS"
    if done and not (c.options.get("initial_load") or c.options.get("force_reload")):
        return c.done("FullReload", df.limit(0), c.last)
    c.metrics.count("delta.reload.triggered", table=c.table)
    return c.done("FullReload", df, c.now.isoformat())


def _greatest(df: DataFrame, col: str | Column) -> str | None:
    v = df.agg(F.max(col)).first()[0]
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else None if v is None else str(v)


def timestamp(c: Context):
    """Rows whose time lies after the cursor (strictly). Ties that come later, and deletes, are not seen."""
    col, df = c.options.get("column", "updated_at"), c.source()
    since = F.lit(c.last or "1970-01-01T00:00:00").cast(df.schema[col].dataType)
    new = df.where(F.col(col) > since)
    return c.done("TimestampDelta", new, _greatest(new, col) or c.last)


def composite(c: Context):
    """A cursor of (time, key) up to a bound taken at the start, with an overlap that the target's merge
    removes again."""
    col, key, df = c.options.get("column", "updated_at"), c.options["key"], c.source()
    kind = df.schema[col].dataType
    upper = F.lit((c.options.get("upper") or c.now).isoformat()).cast(kind)
    old, old_key = (c.cursor.more.get("time"), c.cursor.more.get("key")) if c.cursor else (None, None)
    new = df.where(F.col(col) <= upper)
    if old is not None:
        since = F.lit(old).cast(kind) - F.expr(f"interval {int(c.options.get('overlap_s', 0))} seconds")
        new = new.where((F.col(col) > since) | ((F.col(col) == since) & (F.col(key) > F.lit(old_key))))
    top = new.agg(F.max(F.struct(col, key))).first()[0]
    time, k = (top[0].isoformat(), top[1]) if top else (old, old_key)
    return c.done("CompositeCursor", new, time, time=time, key=k)


def partition(c: Context):
    """Closed days: after the last one done (less a lookback) and before today. A range on the partition
    column, so that only those folders are read."""
    col, df = c.options.get("column", "dt"), c.source()
    last = dt.date.fromisoformat(c.last) if c.last else dt.date(1970, 1, 1)
    back = int(c.options.get("lookback_days", 0))
    new = df.where((F.col(col) > F.lit(last - dt.timedelta(days=back))) & (F.col(col) < F.lit(c.now.date())))
    seen = _greatest(new, col)
    return c.done("PartitionDelta", new, max(filter(None, (seen, c.last)), default=None))


def _files(c: Context) -> list[tuple[str, str, int]]:
    """(name, uri, size) of the files of the landing folder that match the pattern."""
    p = c.spark._jvm.org.apache.hadoop.fs.Path(c.options["path"])
    fs = p.getFileSystem(c.spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in (fs.listStatus(p) if fs.exists(p) else ()) if s.isFile()]
    return sorted(x for x in found if fnmatch.fnmatch(x[0], c.options.get("pattern", "*")) and not x[0].startswith(("_", ".")))


def _load(c: Context, uris: list[str]) -> DataFrame:
    """Each file with its own columns, united by name. With the option ``schema`` all files are one scan, in which
    columns that a file lacks are null; Parquet without it is one scan too, whose schema Spark merges from all footers
    in the cluster. Other formats are one scan for each set of columns, found file by file."""
    fmt = c.options.get("format", "parquet")
    read = c.spark.read.format(fmt).options(**({"header": "true", "inferSchema": "true"} if fmt == "csv" else {}))
    groups: dict[str, list[str]] = {}
    if "schema" in c.options:
        read, groups = read.schema(c.options["schema"]), {"": uris}
    elif fmt == "parquet":
        read, groups = read.option("mergeSchema", "true"), {"": uris}
    else:
        for uri in uris:
            groups.setdefault(read.load(uri).schema.simpleString(), []).append(uri)
    frames = [read.load(u).withColumns({"_source_file": F.col("_metadata.file_name"), "_ingestion_time": F.lit(c.now).cast("timestamp_ntz")}) for u in groups.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def landing(c: Context):
    """Files whose names come after the last one done; files that arrive out of order are missed."""
    files = [x for x in _files(c) if c.last is None or x[0] > c.last]
    c.metrics.gauge("delta.landing.new_files", len(files), table=c.table)
    if not files:
        return c.done("LandingZone", c.spark.createDataFrame([], T.StructType()), c.last, files=[])
    return c.done("LandingZone", _load(c, [u for _, u, _ in files]), files[-1][0], files=[u for _, u, _ in files])


def manifest(c: Context):
    """Files (by address and size) that the manifest of earlier runs doesn't list, whatever their names."""
    known = {tuple(x) for x in (c.cursor.more.get("done", []) if c.cursor else [])}
    files = [x for x in _files(c) if (x[1], x[2]) not in known]
    done = [*map(list, known), *([u, n] for _, u, n in files)]
    if not files:
        return c.done("ManifestLanding", c.spark.createDataFrame([], T.StructType()), c.last, done=done, files=[])
    return c.done("ManifestLanding", _load(c, [u for _, u, _ in files]), files[-1][0], done=done, files=[u for _, u, _ in files])


def archive(c: Context, cursor: Cursor, folder: str) -> None:
    """Move the files of a committed run away."""
    path = c.spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(c.spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for uri in cursor.more.get("files", []):
        fs.rename(path(uri), path(f"{folder}/{uri.rsplit('/', 1)[1]}"))


def debezium(df: DataFrame) -> DataFrame:
    """Envelopes (payload of before, after, source.lsn, op, ts_ms) as changes; those without a position go."""
    op = F.col("payload.op")
    kind = op
    for code, name in OPERATIONS.items():
        kind = F.when(op == code, name).otherwise(kind)
    out = df.select(
        F.col("payload.before").alias("_before"), F.col("payload.after").alias("_after"), F.col("payload.source.lsn").cast("long").alias("_lsn"),
        kind.alias("_change_type"), F.timestamp_millis(F.col("payload.ts_ms").cast("long")).alias("_change_timestamp"),
    ).where("_lsn is not null")
    return out.withColumn("data", F.when(F.col("_change_type") == "delete", F.col("_before")).otherwise(F.col("_after")))


def trigger(df: DataFrame) -> DataFrame:
    """Rows of a trigger's change table."""
    return df.withColumnsRenamed({"cdc_id": "_lsn", "operation": "_change_type", "changed_at": "_change_timestamp"}).withColumn("_change_type", F.lower("_change_type"))


def cdc(c: Context):
    """Changes after the last position, by format."""
    kind = c.options.get("cdc_format", "debezium")
    if kind == "wal":
        raise NotImplementedError("reading a replication slot consumes it; land its changes as files and read those")
    if kind not in ("debezium", "trigger"):
        raise ValueError(f"unknown CDC format {kind}")
    if kind == "debezium" and "frame" not in c.options:
        df = c.spark.read.schema(c.options["schema"]).option("multiLine", "true").json(c.options["path"])
    else:
        df = c.source()
    new = debezium(df) if kind == "debezium" else trigger(df)
    new = new.where(F.col("_lsn") > F.lit(int(c.last or 0)))
    by = {r["_change_type"]: r["count"] for r in new.groupBy("_change_type").count().collect()}
    for op, n in by.items():
        c.metrics.count(f"delta.cdc.operation.{op}", n, table=c.table)
    return c.done("CdcDelta", new, _greatest(new, "_lsn") or c.last, operations=by)


def apply_changes(target: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A table after its changes: the last change of each key (by position) wins, and a delete removes it.
    ``changes``: keys, other columns, ``_lsn`` and ``_change_type``. Running a batch twice changes nothing."""
    cols = [x for x in changes.columns if not x.startswith("_") and x not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct("_lsn", "_change_type", *cols)).alias("r"))
    alive = last.where("r._change_type <> 'delete'").select(*keys, *(F.col(f"r.{x}").alias(x) for x in cols))
    return alive if target is None else target.join(last.select(*keys), keys, "left_anti").unionByName(alive, allowMissingColumns=True)


def replay(state: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """As ``apply_changes``, for batches that come in any order or again: the state keeps each key's position, and
    deleted keys with ``_deleted`` set (see ``alive``), so that a change older than the state's is without effect."""
    cols = [x for x in changes.columns if not x.startswith("_") and x not in keys]
    rows = changes.select(*keys, "_lsn", (F.col("_change_type") == "delete").alias("_deleted"), *cols)
    if state is not None:
        rows = rows.unionByName(state, allowMissingColumns=True)
    rest = [x for x in rows.columns if x not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r"))
    return last.select(*keys, *(F.col(f"r.{x}").alias(x) for x in rest))


def alive(state: DataFrame) -> DataFrame:
    """The rows of a state of ``replay``."""
    return state.where("not _deleted").drop("_lsn", "_deleted")


def change_feed(c: Context):
    """Changes of a versioned table since the last version read: first everything, later its difference.
    Only a missing table is an empty source."""
    table = VersionedTable(c.spark, c.options["path"])
    now = table.version
    if now is None:
        raise FileNotFoundError(c.options["path"])
    if c.last is None:
        return c.done("DeltaLakeMerge", table.read(now).withColumn("_change_type", F.lit("insert")), str(now))
    df = table.changes(int(c.last), c.options["keys"], now)
    return c.done("DeltaLakeMerge", df.where("_change_type <> 'update_preimage'") if now > int(c.last) else df.limit(0), str(now))


#: name -> (strategy, sizes it is meant for)
STRATEGIES: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "CdcDelta": (cdc, ("LARGE", "WHALE")),
    "DeltaLakeMerge": (change_feed, ("LARGE", "WHALE")),
    "PartitionDelta": (partition, ("MEDIUM", "LARGE")),
    "TimestampDelta": (timestamp, ("SMALL", "MEDIUM")),
    "CompositeCursor": (composite, ("SMALL", "MEDIUM")),
    "LandingZone": (landing, ("SMALL", "MEDIUM", "LARGE", "WHALE")),
    "ManifestLanding": (manifest, ("SMALL", "MEDIUM", "LARGE", "WHALE")),
    "FullReload": (full_reload, ("SMALL", "MEDIUM", "LARGE", "WHALE")),
}
#: Order in which strategies are tried for a tenant whose own doesn't fit.
CHAIN = ("CdcDelta", "DeltaLakeMerge", "PartitionDelta", "TimestampDelta", "FullReload")


def register(name: str, strategy: Callable, sizes: tuple[str, ...]) -> None:
    STRATEGIES[name] = (strategy, sizes)


def supports(name: str, tenant: Tenant) -> bool:
    return tenant.size in STRATEGIES[name][1]


def pick(which: str | Tenant) -> tuple[str, Callable]:
    """By name (an unknown one is an error), or for a tenant: its own strategy, else the first that fits."""
    if isinstance(which, str):
        if which not in STRATEGIES:
            raise KeyError(f"unknown strategy {which}")
        return which, STRATEGIES[which][0]
    name = which.strategy_name
    if name not in STRATEGIES or not supports(name, which):
        name = next(n for n in CHAIN if supports(n, which))
    return name, STRATEGIES[name][0]
