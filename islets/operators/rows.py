"""Small building blocks shared by all graph steps.

Graph state is always plain rows ``(id, nbr)``; a step turns rows into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair(id: Column, nbr: Column, *, when: Column | None = None, **extra: Column) -> Column:
    """One outgoing row ``(id, nbr, **extra)``, or NULL where ``when`` does not hold."""
    row = F.struct(
        id.alias("id"), nbr.alias("nbr"), *(value.alias(name) for name, value in extra.items())
    )
    return row if when is None else F.when(when, row)


def emit(frame: DataFrame, *rows: Column) -> DataFrame:
    """Turn each input row into several outgoing rows in one pass over the input.

    A union of projections would run the plan below it once per branch.
    """
    sent = frame.select(F.inline(F.array(*rows)))
    return sent.where(F.col("id").isNotNull())


def both_directions(edges: DataFrame) -> DataFrame:
    """Each row ``(id, nbr)`` and its reverse."""
    id, nbr = F.col("id"), F.col("nbr")
    return emit(edges, pair(id, nbr), pair(nbr, id))


def local_minimum(rows: DataFrame) -> DataFrame:
    """``(id, m, n)``: the least id among a vertex and its neighbours, and its number of rows.

    ``min`` and ``count`` combine on the map side, so a hub costs one partial row per task.
    """
    return rows.groupBy("id").agg(
        F.least(F.col("id"), F.min("nbr")).alias("m"), F.count(F.lit(1)).alias("n")
    )
