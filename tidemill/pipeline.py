"""Extract, validate, transform, load, then commit the cursor."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemill import errors
from tidemill.config import Tenant
from tidemill.metrics import Metrics
from tidemill.operators.quality import CRITICAL, CriticalViolation, Quarantine, Rule, split
from tidemill.operators.transforms import chain
from tidemill.sources.strategies import Context, pick
from tidemill.sources.versioned import VersionedTable
from tidemill.state import Cursor, CursorStore, JobLog, StageStore

STAGES = ("extract", "validate", "transform")


@dataclass(frozen=True)
class Definition:
    name: str
    source: str
    target: str
    mode: str = "append"  # append, overwrite, merge, delete_insert
    keys: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    transforms: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    strategy: str | None = None

    def __post_init__(self):
        for x in ("name", "source", "target"):
            if not getattr(self, x):
                raise ValueError(f"{x} is required")
        if self.mode not in ("append", "overwrite", "merge", "delete_insert"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode in ("merge", "delete_insert") and not self.keys:
            raise ValueError(f"{self.mode} needs keys")


@dataclass
class Result:
    status: str  # SUCCESS, FAILED, SKIPPED, PARTIAL
    processed: int = 0
    quarantined: int = 0
    error: str | None = None
    duration_ms: int = 0


class Pipeline:
    def __init__(self, spark: SparkSession, folder: str, metrics: Metrics | None = None, breaker: errors.Breaker | None = None, sleep=time.sleep):
        self.spark, self.metrics, self.breaker, self.sleep = spark, metrics or Metrics(), breaker or errors.SHARED, sleep
        self.cursors, self.jobs, self.stages = CursorStore(spark, folder), JobLog(spark, folder), StageStore(spark, folder)
        self.quarantine = Quarantine(f"{folder.rstrip('/')}/quarantine")

    def _stage(self, d: Definition, tenant: Tenant, stage: str, fn: Callable[[], DataFrame]) -> DataFrame:
        """A stage's output, written so that later stages and counts don't extract again; on a rerun after a
        failure it is read back."""
        who = tenant.customer_id
        found = self.stages.load(d.name, stage, who) if tenant.checkpoint else None
        if found is not None:
            return found
        with self.metrics.timer("stage_duration_ms", stage=stage, pipeline=d.name):
            return errors.call(lambda: self.stages.save(fn(), d.name, stage, who), tenant.retry, (who, stage), self.breaker, self.metrics, self.sleep)

    def run(self, tenant: Tenant, d: Definition, now: dt.datetime) -> Result:
        began, out, cursor = time.time(), None, None
        try:
            out, cursor = self._run(tenant, d, now)
        except Exception as e:
            self.metrics.count("pipeline_failed", pipeline=d.name)
            out = Result("FAILED", error=f"{type(e).__name__}: {e}"[:2000])
        if cursor is not None:  # only now that the target holds the rows
            cursor.record_count = out.processed
            self.cursors.save(cursor)
            self.stages.clean(d.name, list(STAGES), tenant.customer_id)
            self.metrics.count("pipeline_success", pipeline=d.name)
        out.duration_ms = round((time.time() - began) * 1000)
        self.metrics.observe("pipeline_duration_ms", out.duration_ms, pipeline=d.name)
        self.metrics.gauge("pipeline_records_processed", out.processed, pipeline=d.name)
        self.jobs.add(d.name, tenant.customer_id, out.status, began, time.time(), out.processed, out.quarantined, out.error)
        return out

    def _run(self, tenant: Tenant, d: Definition, now: dt.datetime):
        name, strategy = pick(d.strategy or tenant)
        context = Context(self.spark, tenant, d.source, d.options, self.cursors.load(tenant.customer_id, d.source, name), now, self.metrics)
        pending = f"pending/{d.name}-{tenant.customer_id}.json"
        if tenant.checkpoint and self.stages.has(d.name, "extract", tenant.customer_id):
            df, cursor = None, Cursor(**self.jobs.files.get(pending))  # the cursor that belongs to the saved rows
        else:
            df, cursor = errors.call(lambda: strategy(context), tenant.retry, (tenant.customer_id, "plan"), self.breaker, self.metrics, self.sleep)
            if not df.columns:
                return Result("SKIPPED"), None
            self.jobs.files.delete(pending)
            self.jobs.files.put(pending, asdict(cursor))
        plan = df
        df = self._stage(d, tenant, "extract", lambda: plan)
        n = df.count()
        self.metrics.gauge("delta.records.extracted", n, table=d.source)
        if not n:
            self.stages.clean(d.name, list(STAGES), tenant.customer_id)
            return Result("SKIPPED"), None
        bad_rows = 0
        if d.rules and tenant.quarantine:
            valid, bad = split(df, list(d.rules), tenant.customer_id, d.source, d.name, now)
            bad_rows = bad.count()
            if bad_rows:
                # The cursor of the saved rows names the batch: a rerun after a failed load writes the same one again.
                batch = hashlib.md5(json.dumps([d.name, tenant.customer_id, asdict(cursor)], default=str, sort_keys=True).encode()).hexdigest()
                self.quarantine.write(bad, batch)
                if not bad.where(bad["_quarantine_severity"] == CRITICAL).isEmpty():
                    self.stages.clean(d.name, list(STAGES), tenant.customer_id)  # so that a corrected source is extracted again
                    raise CriticalViolation(f"{d.name}: a critical rule is violated")
            df = self._stage(d, tenant, "validate", lambda: valid.drop("_warnings"))
        if d.transforms:
            df = self._stage(d, tenant, "transform", lambda: chain(df, list(d.transforms)))
        loaded = df.count()
        self._load(d, df)
        return Result("PARTIAL" if bad_rows else "SUCCESS", loaded, bad_rows), cursor

    def _load(self, d: Definition, df: DataFrame) -> None:
        t = VersionedTable(self.spark, d.target)
        if d.mode == "merge":
            updated = t.matches(df, list(d.keys))
            t.upsert(df, list(d.keys))
            self.metrics.count("delta.lake.rows.updated", updated, table=d.target)
        elif d.mode == "delete_insert":
            t.delete_insert(df, list(d.keys))
        elif d.mode == "overwrite":
            t.overwrite(df)
        else:
            t.append(df)
