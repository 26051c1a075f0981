"""Steps of tree pruning: vertices leave the graph once they know a smaller one and hang below it.

``min_selection`` and ``prune_links`` alternate until no live row is left; ``prune_tree_edges``
collects the forest on the way and ``propagate`` carries the root's label down the forest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup
from islets.operators.rows import emit, local_minimum, pair


def min_selection(
    live: DataFrame, *, edge_pruning: bool = True, hubs: Hubs | None = SAFE, dedup: bool = True
) -> DataFrame:
    """Each vertex tells itself and its neighbours the least id around it.

    With ``edge_pruning`` a vertex that is itself the least stays silent towards its neighbours,
    who hear of it anyway.  Vertices without another neighbour send nothing.
    """
    id, nbr, m = F.col("id"), F.col("nbr"), F.col("m")
    seen = live.groupBy("id").agg(
        F.least(id, F.min("nbr")).alias("m"),
        F.count(F.lit(1)).alias("n"),
        F.max(nbr != id).alias("linked"),
    )
    around = kept(seen, hubs)
    senders = around.where("linked").select("id", "m")
    speaking = senders.where(m < id) if edge_pruning else senders
    told = lookup(live, speaking, "id", hubs, counts=around)
    sent = senders.select("id", m.alias("nbr")).unionByName(
        told.select(nbr.alias("id"), m.alias("nbr"))
    )
    return sent.distinct() if dedup else sent


def heard_minima(heard: DataFrame) -> DataFrame:
    """``(id, m, n, named)``: the least minimum a vertex heard of, how many it heard of, and whether
    itself is among them.  Both halves of the pruning step start from these."""
    return heard.groupBy("id").agg(
        F.min("nbr").alias("m"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("nbr") == F.col("id")).alias("named"),
    )


def prune_links(
    heard: DataFrame,
    minima: DataFrame | None = None,
    *,
    oblivious_seed: bool = False,
    hubs: Hubs | None = SAFE,
    dedup: bool = True,
) -> DataFrame:
    """New links of the live graph: every minimum a vertex heard of is linked to the least of them.

    ``oblivious_seed`` keeps the other minima from the least one, which then only knows itself:
    fewer rows per round, but many more rounds on long paths.  ``minima`` is the result of
    :func:`heard_minima`, for callers that have it written.
    """
    id, nbr, m = F.col("id"), F.col("nbr"), F.col("m")
    around = kept(heard_minima(heard), hubs) if minima is None else minima
    torn = around.where("n > 1")
    joined = lookup(heard, torn.select("id", "m"), "id", hubs, counts=around)
    if oblivious_seed:
        sent = emit(joined, pair(nbr, m, when=nbr != m)).unionByName(
            torn.select(m.alias("id"), m.alias("nbr"))
        )
    else:
        sent = emit(joined, pair(nbr, m, when=nbr != m), pair(m, nbr))
    return sent.distinct() if dedup else sent


def prune_tree_edges(heard: DataFrame | None = None, minima: DataFrame | None = None) -> DataFrame:
    """``(id, parent)`` for each vertex that nobody named as a minimum: it leaves the live graph."""
    around = heard_minima(heard) if minima is None else minima
    return around.where(~F.col("named")).select("id", F.col("m").alias("parent"))


def merge_forest(forest: DataFrame, tree_edges: DataFrame) -> DataFrame:
    """Add tree edges to a forest of ``(id, parent)`` rows, where a NULL parent states a root.

    A vertex is pruned once, so it has at most one row with a parent.
    """
    return (
        forest.unionByName(tree_edges).groupBy("id").agg(F.max("parent").alias("parent"))
    )


def prepare_propagation(tree_edges: DataFrame) -> DataFrame:
    """One row ``(id, parent)`` per vertex of the forest; roots become their own parent."""
    nodes = tree_edges.select(
        F.inline(
            F.array(
                F.struct(F.col("id"), F.col("parent")),
                F.struct(
                    F.col("parent").alias("id"),
                    F.lit(None).cast(tree_edges.schema["parent"].dataType).alias("parent"),
                ),
            )
        )
    ).where(F.col("id").isNotNull())
    merged = nodes.groupBy("id").agg(F.max("parent").alias("parent"))
    return merged.select("id", F.coalesce("parent", "id").alias("parent"))


def pointer_jump(parents: DataFrame, *, hubs: Hubs | None = SAFE, with_old: bool = False) -> DataFrame:
    """Replace each parent by the parent's parent; ``with_old`` keeps the former in ``old``."""
    above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grandparent"))
    jumped = lookup(parents, above, "parent", hubs)
    old = [F.col("parent").alias("old")] if with_old else []
    return jumped.select("id", F.col("grandparent").alias("parent"), *old)
