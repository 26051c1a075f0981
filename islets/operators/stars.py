"""Steps of star alternation: large-star, small-star, and splitting of hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import HUB_ROWS, SAFE, Hubs, kept, lookup
from islets.operators.rows import emit, local_minimum, pair


def orient(edges: DataFrame) -> DataFrame:
    """Each row with its larger end first."""
    id, nbr = F.col("id"), F.col("nbr")
    return edges.select(F.greatest(id, nbr).alias("id"), F.least(id, nbr).alias("nbr"))


def large_star(
    edges: DataFrame,
    *,
    hubs: Hubs | None = SAFE,
    dedup: bool = True,
    oriented: bool = False,
    loops: bool = True,
) -> DataFrame:
    """Link each larger neighbour, and the vertex itself, to the least id around the vertex.

    With the larger end of an edge first, a vertex that has a row of its own finds the least id
    there, and one without is the least itself.  So each edge is needed in one direction only: its
    smaller end is looked up, and what is found there goes to the larger end.  ``oriented`` states
    that no row has ``id < nbr``.  Without ``loops``, local minima are not stated by a row that links
    them to themselves.
    """
    id, nbr, m = F.col("id"), F.col("nbr"), F.col("m")
    edges = edges if oriented else orient(edges)
    below = kept(edges.groupBy("id").agg(F.min("nbr").alias("m")), hubs)
    at_nbr = below.select(F.col("id").alias("nbr"), "m")
    joined = lookup(edges, at_nbr, "nbr", hubs, how="left")
    if loops:
        found = emit(
            joined,
            pair(id, F.coalesce(m, nbr), when=id > nbr),
            pair(nbr, nbr, when=m.isNull()),
        )
    else:
        found = joined.select("id", F.coalesce(m, nbr).alias("nbr"))
    sent = found.unionByName(below.select("id", m.alias("nbr")))
    return sent.distinct() if dedup else sent


def small_star(
    edges: DataFrame,
    *,
    hubs: Hubs | None = SAFE,
    dedup: bool = True,
    oriented: bool = False,
    loops: bool = True,
) -> DataFrame:
    """Link each smaller neighbour, and the vertex itself, to the least of the smaller neighbours.

    ``oriented`` and ``loops`` as in :func:`large_star`, whose output is oriented.
    """
    id, nbr, m = F.col("id"), F.col("nbr"), F.col("m")
    edges = edges if oriented else orient(edges)
    around = kept(local_minimum(edges), hubs)
    joined = lookup(edges, around.select("id", "m"), "id", hubs, counts=around)
    found = joined if loops else joined.where(nbr != m)
    sent = found.select(nbr.alias("id"), m.alias("nbr")).unionByName(
        around.select("id", m.alias("nbr"))
    )
    return sent.distinct() if dedup else sent


def local_maxima(links: DataFrame) -> DataFrame:
    """``(id, nbr)``: vertices without a larger neighbour and their least one; ``links`` have the larger end first."""
    least = links.groupBy("id").agg(F.min("nbr").alias("nbr"))
    return least.join(links.select(F.col("nbr").alias("id")).distinct(), "id", "left_anti")


def without_maxima(links: DataFrame, maxima: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """``links`` without the vertices of ``maxima``, whose other neighbours are linked to the least one instead.

    This is :func:`small_star` at these vertices, less the links to them.  Links may come more than once.
    """
    id, nbr, m = F.col("id"), F.col("nbr"), F.col("m")
    joined = lookup(links, maxima.select("id", nbr.alias("m")), "id", hubs, how="left")
    left = joined.where(m.isNull() | (nbr != m))
    return left.select(F.when(m.isNull(), id).otherwise(nbr).alias("id"), F.coalesce(m, nbr).alias("nbr"))


def follow_links(links: DataFrame, stars: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """Lead each ``id`` of ``links``, which has one, on to the centre of ``stars`` that its ``nbr`` belongs to or is."""
    above = stars.select(F.col("id").alias("nbr"), F.col("nbr").alias("centre"))
    found = lookup(links, above, "nbr", hubs, how="left")
    return found.select("id", F.coalesce("centre", "nbr").alias("nbr"))


def split_hubs(
    edges: DataFrame,
    *,
    degree: int = HUB_ROWS,
    salts: int | None = None,
    hubs: Hubs | None = SAFE,
) -> DataFrame:
    """Spread the neighbours of vertices with more than ``degree`` of them over virtual vertices.

    Rows ``(id, nbr)`` become ``(id, salt, nbr, nbr_salt)``.  Salt 0 is the real vertex; the virtual
    ones of a hub are ``(hub, 1)``, ``(hub, 2)``, ...  A pair of columns cannot collide with an id.
    Without ``salts`` a hub gets as many virtual vertices as keep each at about ``degree`` rows,
    and neighbours go by hash; with it, the number is fixed and neighbours go by remainder.
    """
    id, nbr, n = F.col("id"), F.col("nbr"), F.col("n")
    degrees = kept(edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")), hubs)
    joined = lookup(edges, degrees, "id", hubs, counts=degrees)
    if salts is None:
        spread = F.pmod(F.xxhash64(nbr), F.ceil(n / F.lit(degree)))
    else:
        spread = F.pmod(nbr, F.lit(salts))
    is_hub = n > degree
    salt = F.when(is_hub, F.lit(1) + spread).otherwise(F.lit(0)).cast("int")
    zero = F.lit(0).cast("int")

    def salted(id, id_salt, nbr, nbr_salt, when=None):
        row = F.struct(
            id.alias("id"), id_salt.alias("salt"), nbr.alias("nbr"), nbr_salt.alias("nbr_salt")
        )
        return row if when is None else F.when(when, row)

    sent = joined.select(
        F.inline(
            F.array(
                salted(id, zero, F.when(is_hub, id).otherwise(nbr), salt),
                salted(id, salt, nbr, zero, when=is_hub),
            )
        )
    ).where(F.col("id").isNotNull())
    return sent.distinct()


def as_vertex_pairs(split: DataFrame) -> DataFrame:
    """Rows of :func:`split_hubs` as ``(id, nbr)`` with ``(id, salt)`` structs for vertices.

    Structs order by id, then salt, so a virtual vertex always sorts after its own hub and the least
    vertex of a component is a real one.
    """
    return split.select(
        F.struct(F.col("id"), F.col("salt")).alias("id"),
        F.struct(F.col("nbr").alias("id"), F.col("nbr_salt").alias("salt")).alias("nbr"),
    )


def drop_virtual(labels: DataFrame) -> DataFrame:
    """Labels over ``(id, salt)`` structs to labels over ids: the rows of the real vertices."""
    return labels.where(F.col("id.salt") == 0).select(
        F.col("id.id").alias("id"), F.col("component.id").alias("component")
    )


def star_labels(stars: DataFrame) -> DataFrame:
    """``(id, component)``: the least neighbour of each vertex, or itself."""
    return local_minimum(stars).select("id", F.col("m").alias("component"))


def labels_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``changed``: how many vertices have another label, or one on one side only."""
    both = before.select("id", F.col("component").alias("old")).join(
        after.select("id", F.col("component").alias("new")), "id", "full_outer"
    )
    return both.agg(F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))
