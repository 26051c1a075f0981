"""Edge tables: from text, from any two columns, and their basic forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+$"


def _integer(field: Column) -> Column:
    """A field as long; NULL unless it is digits with an optional sign and fits.

    ``try_cast`` alone would also accept surrounding blanks.
    """
    return F.when(field.rlike(INTEGER), field.try_cast("bigint"))


def parse_edge_lines(lines: DataFrame, sep: str = "space") -> DataFrame:
    """``(src, dst)`` from a frame with one string column of lines.

    ``sep`` is a regular expression, or the word ``space`` for a blank.  The first two fields count,
    further ones are ignored, and lines without two integers are dropped.
    """
    pattern = " " if sep == "space" else sep
    fields = F.split(F.col(lines.columns[0]), pattern)
    parsed = lines.select(
        _integer(F.try_element_at(fields, F.lit(1))).alias("src"),
        _integer(F.try_element_at(fields, F.lit(2))).alias("dst"),
    )
    return parsed.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def read_edge_list(spark: SparkSession, path: str | list[str], sep: str = "space") -> DataFrame:
    """Edges from text files, one edge per line; see :func:`parse_edge_lines`."""
    return parse_edge_lines(spark.read.text(path), sep)


def edges_from(frame: DataFrame, src: str | Column, dst: str | Column) -> DataFrame:
    """Edges from two columns or expressions of any frame; rows with a NULL end are dropped."""
    as_column = lambda end: F.col(end) if isinstance(end, str) else end
    edges = frame.select(as_column(src).alias("src"), as_column(dst).alias("dst"))
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every row, copies kept."""
    ends = F.struct(F.col("src"), F.col("dst"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.inline(F.array(ends, back)))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The adjacency as rows ``(id, nbr)``: both directions, without copies.

    Copies are removed per undirected edge, before the directions double the rows.  Rows with
    a NULL end are no edges.
    """
    src, dst = F.col("src"), F.col("dst")
    whole = edges.where(src.isNotNull() & dst.isNotNull())
    once = whole.select(F.greatest(src, dst).alias("id"), F.least(src, dst).alias("nbr")).distinct()
    id, nbr = F.col("id"), F.col("nbr")
    forth = F.struct(id.alias("id"), nbr.alias("nbr"))
    back = F.when(id != nbr, F.struct(nbr.alias("id"), id.alias("nbr")))
    return once.select(F.inline(F.array(forth, back))).where(F.col("id").isNotNull())


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row ``(edges, vertices)``: input rows, copies counted, and distinct ids.

    Rows with a NULL end are no edges.
    """
    whole = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    ends = whole.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).cast("long").alias("edge")),
                F.struct(F.col("dst").alias("id"), F.lit(0).cast("long").alias("edge")),
            )
        )
    )
    per_vertex = ends.groupBy("id").agg(F.sum("edge").alias("edge"))
    return per_vertex.agg(
        F.coalesce(F.sum("edge"), F.lit(0).cast("long")).alias("edges"),
        F.count(F.lit(1)).alias("vertices"),
    )
