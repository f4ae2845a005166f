"""Shared folder, written intermediate tables and Arrow batch sizes."""

from __future__ import annotations

import ctypes
import os
from functools import cache, wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.storage import delete, new_path

#: Rows and bytes of one Arrow batch that goes to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Bytes of a row group of an intermediate table: what a task that writes or reads one holds.
ROW_GROUP = 16 << 20


def tune(spark: SparkSession) -> None:
    """Keep the batches that Python workers hold small, whatever the length of the texts, and let workers find this
    package where the driver has found it. The batch settings are the session's: they hold when a plan runs."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@cache
def _trim():
    """glibc's malloc_trim, or something that does nothing."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: None


_KEPT: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What a module's functions keep in a worker from task to task, until the worker runs another module's."""
    return _KEPT.setdefault(module, {})


def lean(run):
    """A function of Arrow batches that gives freed memory back at its end, and at its start what other modules' functions
    have kept: workers idle between stages hold little."""

    @wraps(run)
    def go(batches):
        for module, held in _KEPT.items():
            if module != run.__module__:
                held.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return go


class Scratch:
    """Tables written in the shared folder, which cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.old = spark, {}, []

    def put(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.paths:
            self.old.append(self.paths[name])
        path = self.paths[name] = new_path(self.spark, name)
        df.write.option("compression", "lz4_raw").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.paths.pop(name))

    def release(self) -> None:
        """Let the driver find the shuffles that no plan needs any more, so that their files are deleted now, not at
        some later collection of the driver's garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def last(self, name: str, df: DataFrame) -> DataFrame:
        """Write the result and delete all other tables; the result's own table stays for its readers."""
        before = [*self.paths.values(), *self.old]
        df = self.put(f"last-{name}", df)
        for path in before:
            delete(self.spark, path)
        self.paths, self.old = {f"last-{name}": self.paths[f"last-{name}"]}, []
        return df


#: Bytes of rows that are sent to all executors where a join may choose.
SMALL = 32 << 20


def bounded(df: DataFrame, row: int) -> DataFrame:
    """A written table of rows of at most ``row`` bytes, to be broadcast if all its rows, which are counted, are at most
    ``SMALL`` bytes; else the join deals both sides."""
    return F.broadcast(df) if df.count() * row <= SMALL else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20):
    """Cut a batch into runs of rows of about ``most`` bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    total = col.nbytes
    if total <= most or batch.num_rows <= 1:
        yield batch
        return
    import pyarrow.compute as pc

    length = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(length):
        size, end = 0, at
        while end < len(length) and (end == at or size + length[end] <= most):
            size += int(length[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
