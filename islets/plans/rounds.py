"""The loop shared by all algorithms: materialise a step, count, record, guard."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.operators.lookup import HUB_ROWS, Hubs, crowded
from islets.plans.workspace import Table, Workspace


class NotConverged(RuntimeError):
    """An algorithm used up its rounds."""


@dataclass
class StepRecord:
    """What one materialised step did; the message and activity fields only with statistics."""

    step: int
    name: str
    millis: int
    messages: int | None = None
    receivers: int | None = None
    active_edges: int | None = None
    degree_max: int | None = None


def merge_rows(messages: DataFrame, *extra: Column) -> DataFrame:
    """Distinct ``(id, nbr)`` rows, with further aggregates over the copies of a row."""
    if not extra:
        return messages.select("id", "nbr").distinct()
    return messages.groupBy("id", "nbr").agg(*extra)


class Rounds:
    """State of one run: its tables, its step records and the guard against endless loops."""

    def __init__(
        self,
        spark: SparkSession,
        algorithm: str,
        *,
        collect_stats: bool = False,
        max_rounds: int | None = None,
        hub_rows: int = HUB_ROWS,
    ):
        self.spark = spark
        self.algorithm = algorithm
        self.collect_stats = collect_stats
        self.max_rounds = max_rounds
        self.hub_rows = hub_rows
        self.work = Workspace(spark, algorithm)
        self.records: list[StepRecord] = []
        self._per_key: list[Table] = []
        self.rounds = 0
        self._last = time.monotonic()

    def hubs(self, rows: int, frame: DataFrame | None = None, *keys: str) -> Hubs | None:
        """How a step over at most ``rows`` rows of ``frame`` treats hubs among the ``keys`` it joins on.

        None can be among few rows; among many, the keys are counted in buckets before the step is split.
        """
        if rows <= self.hub_rows or (frame is not None and not crowded(frame, self.hub_rows, *keys)):
            return None
        return Hubs(self.hub_rows, self.keep)

    def keep(self, per_key: DataFrame) -> DataFrame:
        """Write a frame that is read several times, and keep it until the step that reads it has been written itself."""
        table = self.work.save(per_key, "per-key")
        self._per_key.append(table)
        return table.frame

    def next_round(self) -> None:
        self.rounds += 1
        if self.max_rounds is not None and self.rounds > self.max_rounds:
            raise NotConverged(
                f"{self.algorithm} did not converge within {self.max_rounds} rounds"
            )

    def step(
        self,
        name: str,
        messages: DataFrame,
        merge: Callable[..., DataFrame] = merge_rows,
        *extra: Column,
        drop: tuple[str, ...] = (),
        buckets: tuple[str, int] | None = None,
        about: int | None = None,
        **counts: Column,
    ) -> Table:
        """Merge the messages of a step per receiver, write the result, and record the step."""
        if self.collect_stats:
            extra += (F.count(F.lit(1)).alias("copies"),)
            counts["copies"] = F.sum("copies")
            drop += ("copies",)
        merged = merge(messages, *extra)
        table = self.work.save(merged, name, drop=drop, buckets=buckets, about=about, **counts)
        self.record(name, table, table.counts.get("copies"))
        return table

    def save(
        self,
        name: str,
        frame: DataFrame,
        *,
        buckets: tuple[str, int] | None = None,
        **counts: Column,
    ) -> Table:
        """Write a step whose output has one row per receiver already."""
        table = self.work.save(frame, name, buckets=buckets, **counts)
        self.record(name, table, table.rows)
        return table

    def loaded(self, edges: DataFrame) -> None:
        """Record step 0, the graph as loaded."""
        self._record("load", edges, None)

    def record(self, name: str, table: Table, messages: int | None) -> None:
        self._record(name, table.frame, messages)

    def _record(self, name: str, frame: DataFrame, messages: int | None) -> None:
        for per_key in self._per_key:
            self.work.drop(per_key)
        self._per_key.clear()
        now = time.monotonic()
        record = StepRecord(len(self.records), name, round(1000 * (now - self._last)))
        if self.collect_stats:
            degrees = frame.groupBy("id").count()
            seen = degrees.agg(
                F.count(F.lit(1)).alias("receivers"),
                F.sum("count").alias("edges"),
                F.max("count").alias("degree"),
            ).first()
            record.messages = messages
            record.receivers = seen["receivers"]
            record.active_edges = seen["edges"] or 0
            record.degree_max = seen["degree"] or 0
            now = time.monotonic()
        self.records.append(record)
        self._last = now
