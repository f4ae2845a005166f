"""Cursors, job history and stage checkpoints, in a folder that the driver and executors share."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.storage import publish


class _Files:
    """Small JSON files through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, name: str, value: dict) -> None:
        if not publish(self.spark, f"{self.path}/{name}", json.dumps(value, default=str).encode()):
            raise FileExistsError(f"{self.path}/{name}")

    def get(self, name: str) -> dict:
        stream = self._fs.open(self._p(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        p = self._p(f"{self.path}/{folder}")
        return sorted(n for s in self._fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if self._fs.exists(p) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(f"{self.path}/{name}"), True)


@dataclass
class Cursor:
    customer_id: str
    source_table: str
    strategy: str
    watermark: str | None = None
    record_count: int = 0
    status: str = "SUCCESS"
    extraction_time: str = ""
    more: dict = field(default_factory=dict)


def _safe(*parts: str) -> str:
    return "/".join("".join(c if c.isalnum() or c in "-_." else f"%{ord(c):x}" for c in p) for p in parts)


class CursorStore:
    """One current cursor per (customer, table, strategy), with its history. Each save is a new file, made
    in one step; the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = _Files(spark, path)

    def _folder(self, customer: str, table: str, strategy: str) -> str:
        return "cursors/" + _safe(customer, table, strategy)

    def save(self, c: Cursor) -> None:
        folder = self._folder(c.customer_id, c.source_table, c.strategy)
        last = self.files.names(folder)
        self.files.put(f"{folder}/{int(last[-1].split('.')[0]) + 1 if last else 0:012d}.json", asdict(c))

    def load(self, customer: str, table: str, strategy: str) -> Cursor | None:
        found = self.history(customer, table, strategy, 1)
        return found[0] if found else None

    def history(self, customer: str, table: str, strategy: str, limit: int = 10) -> list[Cursor]:
        folder = self._folder(customer, table, strategy)
        return [Cursor(**self.files.get(f"{folder}/{n}")) for n in self.files.names(folder)[::-1][:limit]]

    def delete(self, customer: str, table: str, strategy: str) -> None:
        self.files.delete(self._folder(customer, table, strategy))


class JobLog:
    """One file per job execution; ``last`` gives the newest first."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = _Files(spark, path)

    def add(self, pipeline: str, customer: str, status: str, started: float, ended: float, processed: int = 0, quarantined: int = 0, error: str | None = None, **more) -> str:
        execution = uuid.uuid4().hex
        self.files.put(f"jobs/{time.time_ns():020d}-{execution}.json", {
            "execution_id": execution, "pipeline_id": pipeline, "customer_id": customer, "status": status, "start_time": started, "end_time": ended, "duration_ms": round((ended - started) * 1000),
            "records_processed": processed, "records_quarantined": quarantined, "error_message": error, "metadata": more,
        })
        return execution

    def last(self, n: int = 10, customer: str | None = None) -> list[dict]:
        out = []
        for name in self.files.names("jobs")[::-1]:
            row = self.files.get(f"jobs/{name}")
            if customer in (None, row["customer_id"]):
                out.append(row)
            if len(out) == n:
                break
        return out


class StageStore:
    """Durable outputs of pipeline stages, by pipeline, stage and customer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, _Files(spark, path)

    def _at(self, pipeline: str, stage: str, customer: str) -> str:
        return "stages/" + _safe(pipeline, stage, customer)

    def save(self, df: DataFrame, pipeline: str, stage: str, customer: str) -> DataFrame:
        meta = {"_checkpoint_pipeline": F.lit(pipeline), "_checkpoint_stage": F.lit(stage), "_checkpoint_customer": F.lit(customer)}
        df.withColumns(meta).write.mode("overwrite").parquet(f"{self.files.path}/{self._at(pipeline, stage, customer)}")
        return self.load(pipeline, stage, customer)

    def has(self, pipeline: str, stage: str, customer: str) -> bool:
        return "_SUCCESS" in self.files.names(self._at(pipeline, stage, customer))

    def load(self, pipeline: str, stage: str, customer: str) -> DataFrame | None:
        if not self.has(pipeline, stage, customer):
            return None
        df = self.spark.read.parquet(f"{self.files.path}/{self._at(pipeline, stage, customer)}")
        return df.drop(*(c for c in df.columns if c.startswith("_checkpoint_")))

    def resume(self, pipeline: str, stages: list[str], customer: str) -> tuple[str, DataFrame] | None:
        """The latest stage that has been saved."""
        for stage in reversed(stages):
            df = self.load(pipeline, stage, customer)
            if df is not None:
                return stage, df
        return None

    def clean(self, pipeline: str, stages: list[str], customer: str) -> None:
        for stage in stages:
            self.files.delete(self._at(pipeline, stage, customer))
