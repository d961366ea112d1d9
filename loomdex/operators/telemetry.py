"""Counts of rows that pass through a run, taken on the way without another pass."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation


class Telemetry:
    """Named spans of one run: metrics that Spark observes while a table is written, and when each span was set up."""

    def __init__(self) -> None:
        self.spans: list[tuple[str, float, Observation]] = []

    def observe(self, rows: DataFrame, span: str, **metrics: Column) -> DataFrame:
        """``rows``, whose ``metrics`` are aggregated when they are next written."""
        seen = Observation(f"{span}-{len(self.spans)}")
        self.spans.append((span, time.time(), seen))
        return rows.observe(seen, *[m.alias(name) for name, m in metrics.items()])

    def report(self) -> list[dict]:
        """The metrics of each span, in order; waits for spans that are still to be written."""
        return [{"span": span, "began": began, **seen.get} for span, began, seen in self.spans]
