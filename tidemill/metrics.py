"""Counters, gauges, histograms and timers in memory, written out as text on flush."""

from __future__ import annotations

import time
from contextlib import contextmanager


class Metrics:
    def __init__(self):
        self.counters: dict[tuple, float] = {}
        self.gauges: dict[tuple, float] = {}
        self.histograms: dict[tuple, list[float]] = {}

    @staticmethod
    def _key(name: str, labels: dict) -> tuple:
        return name, tuple(sorted(labels.items()))

    def count(self, name: str, n: float = 1, **labels) -> None:
        k = self._key(name, labels)
        self.counters[k] = self.counters.get(k, 0) + n

    def gauge(self, name: str, value: float, **labels) -> None:
        self.gauges[self._key(name, labels)] = value

    def observe(self, name: str, value: float, **labels) -> None:
        self.histograms.setdefault(self._key(name, labels), []).append(value)

    @contextmanager
    def timer(self, name: str, **labels):
        began = time.monotonic()
        try:
            yield
        finally:
            self.observe(name, (time.monotonic() - began) * 1000, **labels)

    def value(self, name: str, **labels) -> float:
        k = self._key(name, labels)
        return self.counters.get(k, self.gauges.get(k, 0))

    def flush(self) -> str:
        """All series as lines of the text exposition format (dots in names become underscores)."""
        line = lambda k, v: k[0].replace(".", "_") + ("{" + ",".join(f'{a}="{b}"' for a, b in k[1]) + "}" if k[1] else "") + f" {v:g}"
        out = [line(k, v) for k, v in (*self.counters.items(), *self.gauges.items())]
        for k, v in self.histograms.items():
            out += [line((k[0] + "_count", k[1]), len(v)), line((k[0] + "_sum", k[1]), sum(v))]
        return "\n".join(out)


class NoMetrics(Metrics):
    def count(self, *a, **b) -> None: ...
    def gauge(self, *a, **b) -> None: ...
    def observe(self, *a, **b) -> None: ...
