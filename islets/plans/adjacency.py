"""Edges kept in buckets by the end that speaks, for loops that join the same edges each round.

The labels of a round are kept in as many buckets by id, so a round's join of edges and labels reads both
where they lie: no edge is shuffled or sorted after the graph was written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import MAX_HUBS, Hubs
from islets.plans.rounds import Rounds
from islets.plans.workspace import Table


def bucket_count(run: Rounds) -> int:
    """As many as a shuffle has partitions, so that what was aggregated by id lies in buckets already."""
    return int(run.spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Adjacency:
    """Rows ``(id, nbr)`` in buckets by ``nbr``.

    A bucket is read by one task.  So the edges of hubs, the vertices with more rows than a task may
    get, lie apart in plain files; there are few hubs, and their labels are broadcast.
    """

    table: Table
    hub_edges: Table | None = None
    hub_keys: DataFrame | None = None

    def heard(self, news: DataFrame) -> DataFrame:
        """``(id, label)``: what each vertex hears if the rows ``(id, label)`` of ``news`` are sent."""
        spoken = news.select(F.col("id").alias("nbr"), "label")
        found = self.table.frame.join(spoken.hint("shuffle_hash"), "nbr").select("id", "label")
        if self.hub_edges is None:
            return found
        at_hubs = spoken.join(F.broadcast(self.hub_keys), "nbr", "left_semi")
        loud = self.hub_edges.frame.join(F.broadcast(at_hubs), "nbr").select("id", "label")
        return found.unionByName(loud)

    def drop(self, run: Rounds) -> None:
        run.work.drop(self.table)
        if self.hub_edges is not None:
            run.work.drop(self.hub_edges)


def bucketed_adjacency(
    run: Rounds, edges: DataFrame, hubs: Hubs | None, degrees: DataFrame | None
) -> Adjacency:
    """Write symmetric ``edges`` in buckets; ``degrees`` are ``(id, n)`` of the vertices above the hub limit."""
    n = bucket_count(run)
    if hubs is None:
        table = run.work.save(edges.repartition(n, "nbr"), "adjacency", buckets=("nbr", n))
        return Adjacency(table)
    largest = degrees.orderBy(F.col("n").desc(), "id").limit(MAX_HUBS)
    keys = run.work.save(largest.select(F.col("id").alias("nbr")), "hub-keys").frame
    apart = run.work.save(edges.join(F.broadcast(keys), "nbr", "left_semi").select("id", "nbr"), "hub-edges")
    others = edges.join(F.broadcast(keys), "nbr", "left_anti").select("id", "nbr")
    table = run.work.save(others.repartition(n, "nbr"), "adjacency", buckets=("nbr", n))
    return Adjacency(table, apart, keys)
