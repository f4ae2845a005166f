"""Errors by category, retries with backoff, and a circuit breaker."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tidemill.config import RetryPolicy
from tidemill.metrics import Metrics

#: Categories and severities.
CATEGORIES = ("NETWORK", "DATA_QUALITY", "RESOURCE", "CONFIGURATION", "PERMISSION", "LOGIC", "EXTERNAL", "UNKNOWN")
SEVERITIES = ("WARNING", "ERROR", "CRITICAL")
RETRYABLE = ("NETWORK", "RESOURCE", "EXTERNAL")


class PipelineError(Exception):
    def __init__(self, message: str, category: str = "UNKNOWN", severity: str = "ERROR"):
        if category not in CATEGORIES or severity not in SEVERITIES:
            raise ValueError(f"unknown category {category} or severity {severity}")
        super().__init__(message)
        self.category, self.severity = category, severity

    @property
    def retryable(self) -> bool:
        return self.category in RETRYABLE

    @property
    def quarantine(self) -> bool:
        return self.category == "DATA_QUALITY"


class CircuitOpen(PipelineError):
    def __init__(self, key):
        super().__init__(f"circuit of {key} is open", "EXTERNAL", "CRITICAL")


@dataclass
class Breaker:
    """Opens after so many exhausted calls in a row and lets one call through once the pause is over."""

    threshold: int = 5
    pause_s: float = 60
    clock: Callable[[], float] = time.monotonic
    failures: dict = field(default_factory=dict)
    opened: dict = field(default_factory=dict)

    def check(self, key) -> None:
        if key in self.opened and self.clock() - self.opened[key] < self.pause_s:
            raise CircuitOpen(key)

    def success(self, key) -> None:
        self.failures.pop(key, None)
        self.opened.pop(key, None)

    def failure(self, key) -> bool:
        n = self.failures[key] = self.failures.get(key, 0) + 1
        if n >= self.threshold:
            self.opened[key] = self.clock()
            return True
        return False


SHARED = Breaker()


def retryable(e: Exception, policy: RetryPolicy) -> bool:
    if isinstance(e, PipelineError):
        return e.category in policy.retryable
    return isinstance(e, (ConnectionError, TimeoutError)) or type(e).__name__ in policy.retryable


def delay_ms(policy: RetryPolicy, attempt: int, rand: Callable[[], float] = random.random) -> float:
    base = policy.base_delay_ms * (2**attempt if policy.exponential else 1)
    return min(base * (0.75 + 0.5 * rand()), policy.max_delay_ms)


def call(fn: Callable, policy: RetryPolicy, key=("", ""), breaker: Breaker = SHARED, metrics: Metrics | None = None, sleep: Callable[[float], None] = time.sleep):
    """fn's result; at most max_retries + 1 attempts. key: (customer, operation), for the breaker."""
    metrics = metrics or Metrics()
    breaker.check(key)
    for attempt in range(policy.max_retries + 1):
        try:
            out = fn()
        except Exception as e:
            if not retryable(e, policy):
                raise
            if attempt == policy.max_retries:
                metrics.count("retry.exhausted", operation=key[1])
                if breaker.failure(key):
                    metrics.count("circuit_breaker.opened", operation=key[1])
                raise
            wait = delay_ms(policy, attempt)
            metrics.count("retry.attempt", operation=key[1])
            metrics.observe("retry.delay_ms", wait, operation=key[1])
            sleep(wait / 1000)
        else:
            if attempt:
                metrics.count("retry.success_after_retry", operation=key[1])
            breaker.success(key)
            return out
