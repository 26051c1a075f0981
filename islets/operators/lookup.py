"""Join of many rows to a table holding one row per key, safe for keys that hold most rows.

A plain equi-join sends all rows of one key to one task.  Every join of the graph steps has one
row per key on one side, so keys with too many rows ("hubs") need no shuffle at all: their few
table rows are broadcast and the many rows stay where they are.  The other keys are shuffled.

What is broadcast is bounded whatever the size of the graph: the ``MAX_HUBS`` largest keys at most.
A key that is not among them holds less than ``1 / MAX_HUBS`` of all rows, which one task can take.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUB_ROWS = 4_000_000
"""Rows of one key that a single task may receive."""

MAX_HUBS = 100_000
"""Most keys that are broadcast, each with a few longs."""

HASH_BUCKETS = 1 << 12
"""Into how many buckets :func:`crowded` deals the keys."""


def _as_it_is(frame: DataFrame) -> DataFrame:
    return frame


@dataclass(frozen=True)
class Hubs:
    """How a step treats keys with more than ``limit`` rows.

    ``keep`` may write a per-key frame and return it read back: the split reads it several times.
    Where a step takes ``hubs=None``, its caller knows that no key can have too many rows.
    """

    limit: int = HUB_ROWS
    keep: Callable[[DataFrame], DataFrame] = _as_it_is


SAFE = Hubs()


def crowded(rows: DataFrame, limit: int, *keys: str) -> bool:
    """Whether a value of one of ``keys`` may stand in more than ``limit`` rows.

    Rows are counted by hash of the key.  A bucket holds all rows of its keys, so if no bucket is above
    the limit, no key is.  The counts combine before the shuffle, so this is one pass that moves
    ``HASH_BUCKETS`` rows a task at most.
    """
    buckets = (
        F.struct(F.lit(i).alias("key"), F.pmod(F.xxhash64(key), F.lit(HASH_BUCKETS)).alias("bucket"))
        for i, key in enumerate(keys)
    )
    counted = rows.select(F.inline(F.array(*buckets))).groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return not counted.where(F.col("n") > limit).isEmpty()


def kept(per_key: DataFrame, hubs: Hubs | None) -> DataFrame:
    return per_key if hubs is None else hubs.keep(per_key)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    hubs: Hubs | None = SAFE,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``key``).

    ``counts`` is a frame ``(key, n)`` of rows per key, for callers that have it already.  Without it, steps of
    a run, which may start jobs, count keys in buckets first, and one by one only if there may be a hub.
    """
    if hubs is None:
        return rows.join(table, key, how)
    if counts is None and hubs.keep is not _as_it_is and not crowded(rows, hubs.limit, key):
        return rows.join(table, key, how)
    per_key = counts
    if per_key is None:
        per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # The key breaks ties, so that every evaluation picks the same hubs.
    largest = per_key.where(F.col("n") > hubs.limit).orderBy(F.col("n").desc(), key).limit(MAX_HUBS)
    if counts is None:
        largest = hubs.keep(largest)
    hub_keys = F.broadcast(largest.select(key))
    hub_table = F.broadcast(table.join(hub_keys, key, "left_semi"))
    at_hubs = rows.join(hub_keys, key, "left_semi").join(hub_table, key, how)
    elsewhere = rows.join(hub_keys, key, "left_anti").join(table, key, how)
    return at_hubs.unionByName(elsewhere)
