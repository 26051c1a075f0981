"""Writers for labels, edges, reports and run records.

All write from the executors.  ``format`` is ``text`` for the plain line format, or any Spark format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs
from islets.reports.components import component_sizes, largest_component_edges, size_distribution


def _write(frame: DataFrame, path: str, format: str, mode: str, sep: str) -> None:
    if format == "text":
        line = F.concat_ws(sep, *(F.col(name).cast("string") for name in frame.columns))
        frame = frame.select(line.alias("value"))
    frame.write.format(format).mode(mode).save(path)


def write_labels(
    labels: DataFrame, path: str, *, format: str = "text", mode: str = "errorifexists"
) -> None:
    """Lines ``id component``."""
    _write(labels.select("id", "component"), path, format, mode, " ")


def write_edges(
    edges: DataFrame, path: str, *, format: str = "text", mode: str = "errorifexists"
) -> None:
    """Lines ``src dst``."""
    _write(edges.select("src", "dst"), path, format, mode, " ")


def write_largest_component(
    edges: DataFrame,
    labels: DataFrame,
    path: str,
    *,
    format: str = "text",
    mode: str = "errorifexists",
    hubs: Hubs | None = SAFE,
) -> None:
    """Lines ``src dst`` for the edges of the largest component, both directions."""
    write_edges(largest_component_edges(edges, labels, hubs=hubs), path, format=format, mode=mode)


def write_distribution(
    labels: DataFrame, path: str, *, format: str = "text", mode: str = "append"
) -> None:
    """Lines ``size,components``."""
    _write(size_distribution(component_sizes(labels)), path, format, mode, ",")


def write_stats(
    report: DataFrame, path: str, *, format: str = "text", mode: str = "append"
) -> None:
    """Append the rows of a run report as comma-separated lines."""
    filled = report.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in report.columns)
    ) if format == "text" else report
    _write(filled, path, format, mode, ",")
