"""The graph every algorithm starts from, and the labels every algorithm ends with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.rows import both_directions
from islets.plans.rounds import Rounds
from islets.plans.workspace import Table


@dataclass
class Graph:
    """Distinct undirected edges, written once, with the larger end in ``id``.

    One row per edge halves what is shuffled and stored; :meth:`symmetric` adds the other direction
    during the scan.
    """

    table: Table
    links: int
    loops: int
    vertices: DataFrame | None
    count: int = 0

    def edges(self) -> DataFrame:
        """Each edge once, without self-loops."""
        if not self.loops:
            return self.table.frame
        return self.table.frame.where(F.col("id") != F.col("nbr"))

    def symmetric(self) -> DataFrame:
        return both_directions(self.edges())

    def linked_vertices(self) -> DataFrame:
        return self.edges().select(F.explode(F.array("id", "nbr")).alias("id")).distinct()

    def with_isolated(self, labels: DataFrame | None) -> DataFrame:
        """Add vertices that only a self-loop or the vertex list states, as their own component.

        A label is never above its id, so the minimum keeps the labels that are there.
        """
        stated = []
        if self.loops or labels is None:
            loops = self.table.frame.where(F.col("id") == F.col("nbr")).select("id")
            stated.append(loops)
        if self.vertices is not None:
            stated.append(self.vertices)
        if not stated:
            return labels
        alone = stated[0]
        for more in stated[1:]:
            alone = alone.unionByName(more)
        alone = alone.select("id", F.col("id").alias("component"))
        everyone = alone if labels is None else labels.unionByName(alone)
        return everyone.groupBy("id").agg(F.min("component").alias("component"))


def load_graph(run: Rounds, edges: DataFrame, vertices: DataFrame | None, src: str, dst: str, rows: int | None = None) -> Graph:
    """Drop incomplete rows, orient, deduplicate and write the edges."""
    a, b = F.col(src), F.col(dst)
    oriented = edges.where(a.isNotNull() & b.isNotNull()).select(
        F.greatest(a, b).alias("id"), F.least(a, b).alias("nbr")
    )
    table = run.work.save(
        oriented.distinct(), "edges", about=rows, loops=F.count_if(F.col("id") == F.col("nbr"))
    )
    if vertices is not None:
        first = vertices.columns[0]
        # of two whole-number types the union takes the wider one
        vertices = vertices.where(F.col(first).isNotNull()).select(F.col(first).alias("id"))
    loops = table.counts["loops"]
    return Graph(table, table.rows - loops, loops, vertices)
