"""Steps of the iterate-and-deduplicate component finder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup
from islets.operators.rows import both_directions, local_minimum


def ccf_iterate(pairs: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """Link each vertex above its local minimum, and its other neighbours, to that minimum.

    The result may repeat rows; :func:`ccf_dedup` removes the copies.
    """
    id, nbr, m = F.col("id"), F.col("nbr"), F.col("m")
    known = both_directions(pairs)
    around = kept(local_minimum(known), hubs)
    above = around.where(m < id).select("id", "m")
    joined = lookup(known, above, "id", hubs, counts=around)
    new_pairs = joined.where(nbr != m).select(nbr.alias("id"), m.alias("nbr"))
    return above.select("id", m.alias("nbr")).unionByName(new_pairs)


def ccf_dedup(pairs: DataFrame) -> DataFrame:
    return pairs.distinct()
