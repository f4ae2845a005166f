"""A versioned Parquet table: atomic publish, time travel and a change feed, without a table format.

A version is a manifest (JSON) of data folders. Data is written first; then the manifest appears, whole, under
the next number, which fails if somebody else has taken it. A crash in between leaves the old version in
force, and readers never see a folder or a manifest that is being written. An append adds a folder; an upsert by
a partition column rewrites only the partitions that the source touches, or in which the target holds one of its
keys, so that a key whose partition has changed leaves its old one. A partition goes by its value as text; null and
the empty text are one.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.storage import publish

CHANGES = ("insert", "update_preimage", "update_postimage", "delete")


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests ----

    def versions(self) -> list[int]:
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(log))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    @property
    def version(self) -> int | None:
        return (self.versions() or [None])[-1]

    def exists(self) -> bool:
        return self.version is not None

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"parts": [], "schema": None}
        stream = self._fs.open(self._path(f"{self.path}/_log/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: int | None, parts: list[dict], df: DataFrame) -> int:
        version = 0 if base is None else base + 1
        content = json.dumps({"parts": parts, "schema": df.schema.json()}).encode()
        if not publish(self.spark, f"{self.path}/_log/{version:010d}.json", content):
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if self.partition:
            df.withColumn("_p", self._value()).write.partitionBy("_p").parquet(f"{self.path}/{folder}")
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()]
            values = {n: n.partition("=")[2] for n in found if n.startswith("_p=")}
            # A folder's name spells its value with percent signs.
            return [{"dir": f"{folder}/{n}", "p": None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)} for n, v in values.items()]
        writer.parquet(f"{self.path}/{folder}")
        return [{"dir": folder, "p": None}]

    # ---- reading ----

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self._manifest(self.version if version is None else version)
        if m["schema"] is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p['dir']}" for p in m["parts"]))

    # ---- writing ----

    def overwrite(self, df: DataFrame) -> int:
        base = self.version
        return self._commit(base, self._write(df), df)

    def append(self, df: DataFrame) -> int:
        base = self.version
        if base is None:
            return self.overwrite(df)
        old = self.read(base)
        df = sync(df, old)
        schema = old.unionByName(df, allowMissingColumns=True)
        return self._commit(base, self._manifest(base)["parts"] + self._write(df), schema)

    def append_unseen(self, df: DataFrame, keys: list[str]) -> int:
        """Only rows whose keys the table doesn't hold."""
        return self.append(df.join(self.read().select(*keys), keys, "left_anti") if self.exists() else df)

    def _value(self) -> Column:
        """The partition of a row, as text."""
        return F.nullif(F.col(self.partition).cast("string"), F.lit(""))

    def _replace(self, new: DataFrame, old: DataFrame, base: int, touched: set[str | None] | None) -> int:
        parts = [p for p in self._manifest(base)["parts"] if touched is not None and p["p"] not in touched]
        return self._commit(base, parts + self._write(new), old)

    def _touched(self, df: DataFrame, old: DataFrame, keys: list[str]) -> set[str | None] | None:
        """Partitions of the source's rows and of the target's rows with its keys, of which only the key columns and the
        partition are read. Their number is bounded by the table's partitions."""
        if not self.partition:
            return None
        there = old.join(df.select(*keys), keys, "left_semi").select(self._value().alias("p"))
        return {r[0] for r in df.select(self._value().alias("p")).union(there).distinct().collect()}

    def upsert(self, df: DataFrame, keys: list[str]) -> int:
        """Matched keys are replaced, others inserted. A key twice in the source is an error."""
        from tidemill.operators.merge import check_unique, merge_rows

        base = self.version
        check_unique(df, keys)
        if base is None:
            return self.overwrite(df)
        old = self.read(base)
        touched, part = self._touched(df, old, keys), old
        if touched is not None:
            inside = F.coalesce(self._value().isin([t for t in touched if t is not None]), F.lit(False))
            part = old.where(inside | self._value().isNull() if None in touched else inside)
        return self._replace(merge_rows(part, df, keys), old.unionByName(df, allowMissingColumns=True), base, touched)

    def matches(self, df: DataFrame, keys: list[str]) -> int:
        """How many of the table's rows an upsert would update."""
        from tidemill.operators.merge import matched

        return matched(self.read(), df, keys).count() if self.exists() else 0

    def delete_insert(self, df: DataFrame, keys: list[str]) -> int:
        """Target rows whose key is in the source go, then all source rows come."""
        base = self.version
        if base is None:
            return self.overwrite(df)
        old = self.read(base)
        kept = old.join(df.select(*keys).distinct(), keys, "left_anti")
        both = kept.unionByName(sync(df, old), allowMissingColumns=True)
        return self._commit(base, self._write(both), both)

    def changes(self, since: int, keys: list[str], to: int | None = None) -> DataFrame:
        """Row changes between two versions, with ``_change_type``. None if there is no newer version."""
        from tidemill.operators.merge import diff

        to = self.version if to is None else to
        return diff(self.read(since), self.read(to), keys)


    def evolve(self, df: DataFrame) -> int:
        """Append rows and take over their columns: new ones are added (null in old rows), those that ``df`` lacks go."""
        base = self.version
        if base is None:
            return self.overwrite(df)
        old = self.read(base).select(*(F.col(f.name) if f.name in self.read(base).columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        return self._commit(base, self._write(old.unionByName(df)), df)


def sync(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``df`` in the order of ``like``, new ones last, missing ones null."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in df.columns]
    return df.select("*", *missing).select(*like.columns, *(c for c in df.columns if c not in like.columns))
