"""Progress of running work: monotone, throttled, combined over stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import SparkSession

In, Out = TypeVar("In"), TypeVar("Out")


class Meter:
    """Reports a fraction that never falls, at steps of a quarter per cent or 100 ms, none after cancel."""

    def __init__(self, report: Callable[[float], None], step: float = 0.0025, seconds: float = 0.1, clock: Callable[[], float] = time.monotonic):
        self.report, self.step, self.seconds, self.clock = report, step, seconds, clock
        self.last, self.at, self.cancelled = -1.0, -1e9, False

    def update(self, fraction: float) -> None:
        fraction = min(1.0, max(fraction, self.last, 0.0))
        now = self.clock()
        due = fraction >= self.last + self.step or now - self.at >= self.seconds or fraction >= 1.0 > self.last
        if not self.cancelled and due and fraction > self.last:
            self.last, self.at = fraction, now
            self.report(fraction)


class Combined:
    """The fraction of several stages that run side by side; it doesn't fall within a phase."""

    def __init__(self, expected: dict[str, float]):
        self.expected, self.done, self.best = expected, dict.fromkeys(expected, 0.0), 0.0

    def update(self, stage: str, completed: float) -> float:
        self.done[stage] = min(completed, self.expected[stage])
        self.best = max(self.best, sum(self.done.values()) / max(sum(self.expected.values()), 1e-12))
        return self.best


def in_order(items: Iterable[In], produce: Callable[[In], Out], ahead: int = 4) -> Iterator[Out]:
    """Results in the items' order, with at most ``ahead`` of them made before they are taken."""
    with ThreadPoolExecutor(ahead) as pool:
        waiting: list = []
        for item in items:
            waiting.append(pool.submit(produce, item))
            if len(waiting) >= ahead:
                yield waiting.pop(0).result()
        while waiting:
            yield waiting.pop(0).result()


def cancellable(spark: SparkSession, tag: str):
    """A context in which Spark work carries a tag; ``cancel`` stops it from another thread."""
    from contextlib import contextmanager

    @contextmanager
    def tagged():
        spark.addTag(tag)
        try:
            yield lambda: spark.interruptTag(tag)
        finally:
            spark.removeTag(tag)

    return tagged()
