"""Spans around driver-side stages: timed, an error is recorded and raised on."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .sinks import append_events


class Trace:
    """Collects spans and appends them to the table ``events`` of a folder at the end; without a path it only keeps them."""

    def __init__(self, spark: SparkSession, path: str | None = None, trace_id: str | None = None):
        self.spark, self.path, self.trace_id = spark, path, trace_id or uuid.uuid4().hex
        self.events: list[tuple] = []

    @contextmanager
    def span(self, name: str):
        began = time.perf_counter()
        level, message = "DEFAULT", ""
        try:
            yield self
        except Exception as e:
            level, message = "ERROR", f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            self.events.append((self.trace_id, name, level, message, (time.perf_counter() - began) * 1000))

    def flush(self) -> None:
        if self.path and self.events:
            append_events(self.spark, self.events, f"{self.path}/events")
        self.events = []
