"""Step of cluster exchange: a vertex sends its cluster to its least member, and that to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup


def cluster_messages(clusters: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    id, member, m = F.col("id"), F.col("member"), F.col("m")
    sizes = clusters.groupBy("id").agg(F.min("member").alias("m"), F.count(F.lit(1)).alias("n"))
    least = kept(sizes, hubs)
    joined = lookup(clusters, least.select("id", "m"), "id", hubs, counts=least)
    sent = joined.select(
        F.inline(
            F.array(
                F.struct(m.alias("id"), member.alias("member")),
                F.when(member != m, F.struct(member.alias("id"), m.alias("member"))),
            )
        )
    ).where(F.col("id").isNotNull())
    return sent.unionByName(least.select("id", m.alias("member")))


def hash_to_min_round(clusters: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """One round on rows ``(id, member)``."""
    return cluster_messages(clusters, hubs=hubs).distinct()
