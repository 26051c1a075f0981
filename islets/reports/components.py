"""Reports on a labelling ``(id, component)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, lookup


def component_sizes(labels: DataFrame) -> DataFrame:
    """``(component, size)``."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_counts(sizes: DataFrame) -> DataFrame:
    """One row ``(components, components_without_singletons)``."""
    return sizes.agg(
        F.count(F.lit(1)).alias("components"),
        F.count_if(F.col("size") != 1).alias("components_without_singletons"),
    )


def max_component_size(sizes: DataFrame) -> DataFrame:
    """One row ``max_size``, NULL for an empty graph."""
    return sizes.agg(F.max("size").alias("max_size"))


def size_distribution(sizes: DataFrame) -> DataFrame:
    """``(size, components)``: how many components have each size."""
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def largest_component(sizes: DataFrame) -> DataFrame:
    """The row ``(component, size)`` of the largest component; the smallest label breaks ties."""
    return sizes.orderBy(F.col("size").desc(), "component").limit(1)


def largest_component_edges(
    edges: DataFrame, labels: DataFrame, *, hubs: Hubs | None = SAFE
) -> DataFrame:
    """Both directions of the edges ``(src, dst)`` inside the largest component, copies kept."""
    top = F.broadcast(largest_component(component_sizes(labels)).select("component"))
    inside = labels.join(top, "component", "left_semi").select(F.col("id").alias("dst"))
    # Both ends of an edge share their component, so one end decides for both directions.
    within = lookup(edges, inside, "dst", hubs, how="left_semi")
    ends = F.struct(F.col("src"), F.col("dst"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return within.select(F.inline(F.array(ends, back)))


def degree_stats(adjacency: DataFrame) -> DataFrame:
    """One row ``(vertices, edges, mean_degree, max_degree)`` of ``(id, nbr)`` rows."""
    degrees = adjacency.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.agg(
        F.count(F.lit(1)).alias("vertices"),
        F.coalesce(F.sum("degree"), F.lit(0).cast("long")).alias("edges"),
        (F.sum("degree") / F.count(F.lit(1))).alias("mean_degree"),
        F.max("degree").alias("max_degree"),
    )
