"""Edges from shared membership: vertices that share an arc are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, kept, lookup
from islets.sources.edges import INTEGER


def parse_membership_lines(lines: DataFrame) -> DataFrame:
    """``(vertex, arc)`` from lines ``vertex,arc``; lines without an integer vertex are dropped.

    So are lines that end after the comma; an empty arc counts if a further field follows.
    """
    fields = F.split(F.col(lines.columns[0]), ",")
    vertex = F.try_element_at(fields, F.lit(1))
    # trailing empty fields are no fields
    has_arc = F.size(F.split(F.regexp_replace(F.col(lines.columns[0]), ",+$", ""), ",")) >= 2
    parsed = lines.select(
        F.when(vertex.rlike(INTEGER), vertex.try_cast("bigint")).alias("vertex"),
        F.try_element_at(fields, F.lit(2)).alias("arc"),
        has_arc.alias("has_arc"),
    )
    return parsed.where(F.col("vertex").isNotNull() & F.col("arc").isNotNull() & F.col("has_arc")).drop("has_arc")


def read_membership(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_membership_lines(spark.read.text(path))


def co_occurrence_edges(members: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """Edges ``(src, dst)`` that link every member of an arc to the arc's least member.

    The members of an arc are as connected as by all their pairs, with one row per membership in
    place of a number of rows that grows with the square of the arc.  Copies of a membership give
    copies of an edge; an arc with one vertex gives none.
    """
    vertex, hub = F.col("vertex"), F.col("least")
    ends = members.groupBy("arc").agg(
        F.min("vertex").alias("least"), F.max("vertex").alias("most"), F.count(F.lit(1)).alias("n")
    )
    arcs = kept(ends, hubs)
    shared = arcs.where(F.col("most") != hub).select("arc", "least")
    joined = lookup(members, shared, "arc", hubs, counts=arcs)
    return joined.where(vertex != hub).select(hub.alias("src"), vertex.alias("dst"))


def co_occurrence_degrees(members: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """``(vertex, pairs)``: how many ordered pairs of different vertices start at each vertex.

    This is the size of the full projection, counted per arc instead of written out: a vertex that
    an arc of n rows names c times is in c * (n - c) pairs there, copies counted.
    """
    named = members.groupBy("arc", "vertex").agg(F.count(F.lit(1)).alias("c"))
    arcs = kept(members.groupBy("arc").agg(F.count(F.lit(1)).alias("n")), hubs)
    joined = lookup(named, arcs, "arc", hubs, counts=arcs)
    pairs = joined.groupBy("vertex").agg(
        F.sum(F.col("c") * (F.col("n") - F.col("c"))).alias("pairs")
    )
    return pairs.where("pairs > 0")


def membership_counts(members: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """One row ``(edges, vertices)``: membership rows, and vertices that share an arc."""
    zero = F.lit(0).cast("long")
    rows = members.agg(F.count(F.lit(1)).alias("edges"), zero.alias("vertices"))
    ends = co_occurrence_edges(members, hubs=hubs).select(
        F.explode(F.array("src", "dst")).alias("id")
    )
    linked = ends.distinct().agg(zero.alias("edges"), F.count(F.lit(1)).alias("vertices"))
    return rows.unionByName(linked).agg(
        F.sum("edges").alias("edges"), F.sum("vertices").alias("vertices")
    )
