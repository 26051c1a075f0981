"""Hubs as trees of virtual vertices, so that no vertex has more neighbours than a limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup

LEAST_LIMIT = 4
"""Two links to children, one to the parent, and one to spare."""

EXTRA_LINKS = 0.01
"""Share of the rows that trees may add if the limit is chosen by :func:`degree_limit`."""


def degree_histogram(degrees: DataFrame) -> DataFrame:
    """``(bits, vertices, rows)`` of ``(id, n)``: degrees from ``2^bits`` to below ``2^(bits+1)``; at most 63 rows."""
    bits = (F.length(F.bin("n")) - 1).alias("bits")
    return degrees.groupBy(bits).agg(F.count(F.lit(1)).alias("vertices"), F.sum("n").alias("rows"))


def degree_limit(histogram: DataFrame, share: float = EXTRA_LINKS) -> DataFrame:
    """One row ``degree_limit``: the least power of two whose trees add at most ``share`` of all rows.

    A hub of ``n`` neighbours has about ``2 n / (limit - 1)`` virtual vertices, each with one link up.
    """
    classes = F.col("classes")
    rows = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda so_far, c: so_far + c["rows"])
    limit = lambda at: F.lit(2).cast("double") ** at
    above = lambda at: rows(F.filter(classes, lambda c: c["bits"] >= at))
    fits = lambda at: 2 * above(at) <= F.lit(share) * rows(classes) * (limit(at) - 1)
    # 63 classes at most
    found = histogram.agg(F.collect_list(F.struct("bits", "rows")).alias("classes"))
    least = F.get(F.filter(F.sequence(F.lit(2), F.lit(62)), fits), F.lit(0))
    return found.select(limit(least).cast("long").alias("degree_limit"))


def _vertex(id: Column, level: Column, salt: Column) -> Column:
    return F.struct(id.alias("id"), level.cast("int").alias("level"), salt.cast("long").alias("salt"))


def split_hub_trees(
    edges: DataFrame,
    *,
    degree: int,
    degrees: DataFrame | None = None,
    hubs: Hubs | None = SAFE,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Give each vertex with more than ``degree`` neighbours a tree of virtual ones below it.

    Takes distinct rows ``(id, nbr)`` in both directions without self-loops, and their ``degrees``
    ``(id, n)`` if they are known.  Returns each link once, larger end first, as ``(id, nbr)`` with
    ``(id, level, salt)`` structs for vertices; ``(id, 0, 0)`` is the real vertex and sorts first.  An
    edge between two hubs links a leaf of one to a leaf of the other.

    Neighbours go to leaves by hash, each leaf half filled on average; those beyond a leaf's places go
    to a further leaf of the same hash, so that the limit holds for every hash.  Leaves hang in order on
    inner vertices of ``degree - 1`` children each, level upon level, until ``degree`` of them are left.
    ``keep`` may write the ends with their leaves and return them read back: they are read several times.
    """
    if degree < LEAST_LIMIT:
        raise ValueError(f"a tree needs a degree of at least {LEAST_LIMIT}")
    id, nbr, n, places = F.col("id"), F.col("nbr"), F.col("n"), F.lit(degree - 1)
    zero, one = F.lit(0), F.lit(1)
    if degrees is None:
        degrees = kept(edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")), hubs)
    joined = lookup(edges, degrees, "id", hubs, counts=degrees)
    buckets = F.when(n > degree, F.ceil(2 * n / places)).otherwise(F.lit(None).cast("long"))
    joined = joined.select("id", "nbr", buckets.alias("buckets"))
    # a bucket holds about half of a leaf's places, so no list is large, whatever the hub's size
    joined = joined.withColumn("bucket", F.pmod(F.xxhash64("nbr"), F.col("buckets")))
    at_hub = joined.where("bucket IS NOT NULL")
    placed = at_hub.groupBy("id", "buckets", "bucket").agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))
    placed = placed.select("id", "buckets", "bucket", F.posexplode("nbrs").alias("rank", "nbr"))
    leaf = F.col("bucket") + F.col("buckets") * F.floor(F.col("rank") / places)
    ends = placed.select("id", "nbr", leaf.alias("leaf")).unionByName(
        joined.where("bucket IS NULL").select("id", "nbr", F.lit(None).cast("long").alias("leaf"))
    )
    ends = kept(ends, hubs) if keep is None else keep(ends)

    # the two rows of an edge know one end's leaf each
    own = F.coalesce(F.col("leaf") + 1, zero)
    by_edge = ends.groupBy(F.greatest(id, nbr).alias("hi"), F.least(id, nbr).alias("lo")).agg(
        F.max(F.when(id > nbr, own)).alias("hi_salt"), F.max(F.when(id < nbr, own)).alias("lo_salt")
    )
    level = lambda salt: F.when(F.col(salt) > 0, one).otherwise(zero)
    links = by_edge.select(
        _vertex(F.col("hi"), level("hi_salt"), F.col("hi_salt")).alias("id"),
        _vertex(F.col("lo"), level("lo_salt"), F.col("lo_salt")).alias("nbr"),
    )

    leaves = ends.where("leaf IS NOT NULL").select("id", "leaf")
    if hubs is None:  # no vertex has too many rows for a task: all that follows is done by vertex, in one shuffle
        leaves = leaves.repartition("id")
    leaves = leaves.distinct()
    width = leaves.groupBy("id").agg((F.max("leaf") + 1).alias("width"))
    # level t is too wide for the real vertex while more than degree * places^(t-1) leaves lie below
    wide = F.filter(F.sequence(one, F.lit(40)), lambda t: F.col("width") > degree * F.pow(places, t - 1))
    tops = width.select("id", (F.size(wide) + 1).alias("top"))  # once a hub, not once a leaf
    leaves = lookup(leaves, kept(tops, hubs), "id", hubs)
    t, at, top = F.col("t"), F.col("at"), F.col("top")
    steps = leaves.withColumn("t", F.explode(F.sequence(one, top)))
    steps = steps.select("id", "top", "t", (F.floor(F.col("leaf") / F.pow(places, t - 1)) + 1).alias("at")).distinct()
    is_top = t == top
    under = F.floor((at - 1) / places) + 1
    tree = steps.select(
        _vertex(id, t, at).alias("id"),
        _vertex(id, F.when(is_top, zero).otherwise(t + 1), F.when(is_top, zero).otherwise(under)).alias("nbr"),
    )
    tree = tree.select(F.greatest("id", "nbr").alias("id"), F.least("id", "nbr").alias("nbr"))
    return links.unionByName(tree)


def vertex_numbers(links: DataFrame) -> DataFrame:
    """``(vertex, number)``: a long for each vertex of ``links``; the frame has to be written before it is read twice."""
    ends = links.select(F.inline(F.array("id", "nbr"))).distinct()
    vertex = F.struct("id", "level", "salt").alias("vertex")
    return ends.select(vertex, F.monotonically_increasing_id().alias("number"))


def numbered_links(links: DataFrame, numbers: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """``links`` between the numbers of their ends, larger number first."""

    def at_end(rows: DataFrame, end: str, number: str) -> DataFrame:
        table = numbers.select(F.col("vertex").alias(end), F.col("number").alias(number))
        if hubs is not None:
            return lookup(rows, table, end, hubs)
        # columns are sorted and compared faster than structs
        parts = {f"{end}_{part}": F.col(f"{end}.{part}") for part in ("id", "level", "salt")}
        flat = lambda frame: frame.withColumns(parts).drop(end)
        return flat(rows).join(flat(table), list(parts))

    ends = at_end(at_end(links, "id", "a").select("a", "nbr"), "nbr", "b")
    return ends.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("nbr"))


def named_trees(numbers: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, parent)`` of the real vertices, from labels ``(id, component)`` over their numbers.

    Numbers do not follow the order of ids: the label is still to be found among the ids of a tree.
    """
    real = numbers.where(F.col("vertex.level") == 0)
    named = real.select(F.col("vertex.id").alias("real"), F.col("number").alias("id"))
    return named.join(labels, "id").select(F.col("real").alias("id"), F.col("component").alias("parent"))
