"""Step of the sorted-neighbour component algorithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup
from islets.operators.rows import emit, pair


def ccmr_messages(rows: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """Outgoing rows ``(id, nbr, more)``; ``more`` marks rows of vertices that need another round.

    A local minimum keeps its list.  Any other vertex pairs each neighbour with its first (least)
    one, both ways, and keeps the first for itself unless it lies above all its neighbours.
    """
    id, nbr, first, last = F.col("id"), F.col("nbr"), F.col("first"), F.col("last")
    lists = rows.groupBy("id").agg(
        F.min("nbr").alias("first"), F.max("nbr").alias("last"), F.count(F.lit(1)).alias("n")
    )
    around = kept(lists, hubs)
    joined = lookup(rows, around.drop("n"), "id", hubs, counts=around)
    passing_on = (id > first) & (nbr != first)
    more, settled = F.lit(True), F.lit(False)
    return emit(
        joined,
        pair(id, nbr, when=id < first, more=settled),
        pair(first, nbr, when=passing_on, more=more),
        pair(nbr, first, when=passing_on, more=more),
        pair(id, first, when=(id > first) & (id < last), more=more),
    )


def ccmr_round(rows: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """One round on rows ``(id, nbr)`` without self-loops."""
    return ccmr_messages(rows, hubs=hubs).select("id", "nbr").distinct()
