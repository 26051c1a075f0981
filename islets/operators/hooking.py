"""Steps of hook-and-jump: trees of parent pointers hook onto each other and are flattened.

State is ``(id, parent)``, a root being its own parent; edges stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup
from islets.operators.rows import both_directions


def forest_init(edges: DataFrame) -> DataFrame:
    """First parents from symmetric ``edges``: the least id around.

    A local minimum that nobody chose hooks onto its least neighbour.
    """
    id, parent = F.col("id"), F.col("parent")
    around = edges.groupBy("id").agg(
        F.least(id, F.min("nbr")).alias("parent"), F.min("nbr").alias("next")
    )
    chosen = (
        around.where(parent != id).select(parent.alias("id")).distinct().withColumn("chosen", F.lit(True))
    )
    alone = (parent == id) & F.col("chosen").isNull()
    return around.join(chosen, "id", "left").select(
        "id", F.when(alone, F.col("next")).otherwise(parent).alias("parent")
    )


def star_detection(parents: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """``(id, parent, is_star)``: whether the vertex lies in a tree of depth one at most."""
    parent, grandparent = F.col("parent"), F.col("grandparent")
    above = parents.select(F.col("id").alias("parent"), parent.alias("grandparent"))
    deep = lookup(parents, above, "parent", hubs).where(parent != grandparent)
    marked = (
        deep.select(F.explode(F.array("id", "grandparent")).alias("id"))
        .distinct()
        .withColumn("marked", F.lit(True))
    )
    own = parents.join(marked, "id", "left")
    over = marked.select(F.col("id").alias("parent"), F.col("marked").alias("parent_marked"))
    flagged = lookup(own, over, "parent", hubs, how="left")
    return flagged.select(
        "id",
        "parent",
        (F.col("marked").isNull() & F.col("parent_marked").isNull()).alias("is_star"),
    )


def min_neighbour_parent(
    edges: DataFrame,
    parents: DataFrame,
    *,
    unconditional: bool = False,
    hubs: Hubs | None = SAFE,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """``(id, cand)``: per tree, the least parent seen across an edge of one of its vertices.

    ``unconditional`` leaves out the own root.  ``edges`` are undirected; one orientation is enough.
    ``degrees`` is a frame ``(id, n)`` that saves counting the edges of each vertex again.
    """
    ends = _parents_of_ends(edges, parents, hubs, degrees)
    if unconditional:
        ends = ends.where(F.col("here") != F.col("there"))
    return least_across(ends.select(F.col("here").alias("id"), F.col("there").alias("nbr")))


def _parents_of_ends(
    edges: DataFrame, parents: DataFrame, hubs: Hubs | None, degrees: DataFrame | None = None
) -> DataFrame:
    """Each edge with the parents of its ends, ``here`` of ``id`` and ``there`` of ``nbr``."""
    at_id = parents.select("id", F.col("parent").alias("here"))
    at_nbr = parents.select(F.col("id").alias("nbr"), F.col("parent").alias("there"))
    as_nbr = degrees.select(F.col("id").alias("nbr"), "n") if degrees is not None else None
    one_end = lookup(edges, at_id, "id", hubs, counts=degrees)
    return lookup(one_end, at_nbr, "nbr", hubs, counts=as_nbr)


def contract_edges(
    edges: DataFrame, parents: DataFrame, *, hubs: Hubs | None = SAFE
) -> DataFrame:
    """Undirected edges between the parents of the ends, each once, larger end first; loops are dropped.

    Both ends of a dropped edge are in one tree.  An end and its parent are in one tree as well, so the
    trees that have an edge between them stay the same.
    """
    here, there = F.col("here"), F.col("there")
    ends = _parents_of_ends(edges, parents, hubs).where(here != there)
    return ends.select(F.greatest(here, there).alias("id"), F.least(here, there).alias("nbr")).distinct()


def least_across(edges: DataFrame) -> DataFrame:
    """``(id, cand)``: the least vertex at the other end of an edge; one orientation is enough."""
    return both_directions(edges).groupBy("id").agg(F.min("nbr").alias("cand"))


def _hook(stars: DataFrame, candidates: DataFrame, conditional: bool) -> DataFrame:
    parent, cand = F.col("parent"), F.col("cand")
    hooks = F.col("is_star") & (F.col("id") == parent) & cand.isNotNull()
    if conditional:
        hooks = hooks & (cand < parent)
    joined = stars.join(candidates, "id", "left")
    return joined.select("id", F.when(hooks, cand).otherwise(parent).alias("parent"))


def conditional_star_hook(stars: DataFrame, candidates: DataFrame) -> DataFrame:
    """The root of a star hooks onto a smaller candidate."""
    return _hook(stars, candidates, conditional=True)


def unconditional_star_hook(stars: DataFrame, candidates: DataFrame) -> DataFrame:
    """The root of a star that is still there hooks onto any candidate."""
    return _hook(stars, candidates, conditional=False)


def canonical_label(parents: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """``(id, component)``: each root replaced by the least vertex of its tree."""
    trees = parents.groupBy("parent").agg(
        F.min("id").alias("component"), F.count(F.lit(1)).alias("n")
    )
    least = kept(trees, hubs)
    joined = lookup(parents, least.drop("n"), "parent", hubs, counts=least)
    return joined.select("id", "component")
