"""Tenant and retry settings, and the model settings of the warehouse."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

SIZES = ("SMALL", "MEDIUM", "LARGE", "WHALE")
#: Records up to which a tenant counts as of a size.
SIZE_BOUNDS = {"SMALL": 1_000_000, "MEDIUM": 10_000_000, "LARGE": 100_000_000}
#: Storage and extraction strategy by size.
STORAGE = {"SMALL": "OLTP", "MEDIUM": "OLTP", "LARGE": "OLAP", "WHALE": "OLAP"}
STRATEGY = {"SMALL": "TimestampDelta", "MEDIUM": "PartitionDelta", "LARGE": "DeltaLakeMerge", "WHALE": "CdcDelta"}


def size_of(records: int) -> str:
    return next((s for s, bound in SIZE_BOUNDS.items() if records < bound), "WHALE")


@dataclass(frozen=True)
class RetryPolicy:
    max_retries: int = 3
    base_delay_ms: int = 1000
    max_delay_ms: int = 30_000
    exponential: bool = True
    retryable: tuple[str, ...] = ("NETWORK", "RESOURCE", "EXTERNAL")


@dataclass(frozen=True)
class Tenant:
    customer_id: str
    name: str = ""
    size: str = "SMALL"
    storage: str | None = None
    strategy: str | None = None
    schema: str | None = None
    options: dict = field(default_factory=dict)
    batch_size: int = 10_000
    parallelism: int = 4
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    checkpoint: bool = True
    quarantine: bool = True

    def __post_init__(self):
        if self.size not in SIZES:
            raise ValueError(f"unknown size {self.size}")

    @property
    def storage_type(self) -> str:
        return self.storage or STORAGE[self.size]

    @property
    def strategy_name(self) -> str:
        return self.strategy or STRATEGY[self.size]

    @classmethod
    def from_json(cls, text: str) -> Tenant:
        d = json.loads(text)
        r = d.get("retryPolicy") or {}
        policy = RetryPolicy(r.get("maxRetries", 3), r.get("baseDelayMs", 1000), r.get("maxDelayMs", 30_000), r.get("exponentialBackoff", True), tuple(r.get("retryableExceptions") or RetryPolicy.retryable))
        return cls(
            d["customerId"], d.get("customerName", ""), d.get("customerSize", "SMALL"), d.get("storageType"), d.get("deltaStrategy"), d.get("schemaName"),
            d.get("connectionProperties") or {}, d.get("batchSize", 10_000), d.get("parallelism", 4), policy, d.get("checkpointEnabled", True), d.get("quarantineEnabled", True),
        )


@dataclass(frozen=True)
class Settings:
    """What the models take besides tables. ``as_of`` stands for today."""

    as_of: dt.date = dt.date(2001, 8, 2)
    vip: int = 10_000
    gold: int = 5_000
    silver: int = 1_000
    pair_orders: int = 10
    pair_confidence: float = 0.1


DEFAULT = Settings()
END_OF_TIME = dt.datetime(9999, 12, 31)
