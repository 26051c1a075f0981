"""Step of the min-label algorithm: labels spread along edges, the least one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.lookup import SAFE, Hubs, lookup


def label_messages(
    labels: DataFrame,
    edges: DataFrame,
    *,
    hubs: Hubs | None = SAFE,
    degrees: DataFrame | None = None,
) -> DataFrame:
    """Rows ``(id, label, prev)``: what each vertex keeps, and what it hears from its neighbours.

    ``prev`` is the label of before, NULL for what is heard.  If ``labels`` has a ``changed`` column,
    only changed labels are sent again: the others were heard in an earlier round.  ``degrees`` is a
    frame ``(id, n)`` that saves counting the edges of each vertex again.
    """
    spoken = label_news(labels).select(F.col("id").alias("nbr"), "label")
    counts = degrees.select(F.col("id").alias("nbr"), "n") if degrees is not None else None
    return with_kept(labels, lookup(edges, spoken, "nbr", hubs, counts=counts))


def label_news(labels: DataFrame) -> DataFrame:
    """``(id, label)`` of what is sent in a round."""
    news = labels.where("changed") if "changed" in labels.columns else labels
    return news.select("id", "label")


def with_kept(labels: DataFrame, heard: DataFrame) -> DataFrame:
    """What vertices heard, ``(id, label)``, together with what they have."""
    kept = labels.select("id", "label", F.col("label").alias("prev"))
    nothing = F.lit(None).cast(labels.schema["label"].dataType).alias("prev")
    return kept.unionByName(heard.select("id", "label", nothing))


def merge_labels(messages: DataFrame, *extra) -> DataFrame:
    """The least label per vertex, the one of before, and whether it is below that."""
    return messages.groupBy("id").agg(
        F.min("label").alias("label"),
        F.max("prev").alias("prev"),
        (F.min("label") < F.max("prev")).alias("changed"),
        *extra,
    )


def shortcut_messages(labels: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """Rows ``(id, label, prev)``: what each vertex keeps, and what it learns from the vertices that labels name.

    ``labels`` is a result of :func:`merge_labels`.  A vertex with a new label tells it to the vertex that
    its former label names, and asks the one that its new label names for that one's label.
    """
    told = labels.where("changed").select(F.col("prev").alias("id"), "label")
    named = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
    asked = lookup(labels.select("id", "label"), named, "label", hubs).where(F.col("further") < F.col("label"))
    heard = told.unionByName(asked.select("id", F.col("further").alias("label")))
    nothing = F.lit(None).cast(labels.schema["label"].dataType).alias("prev")
    return labels.select("id", "label", "prev").unionByName(heard.select("id", "label", nothing))


def hash_min_round(labels: DataFrame, edges: DataFrame, *, hubs: Hubs | None = SAFE) -> DataFrame:
    """One synchronous round over symmetric ``edges``: ``(id, label)`` to ``(id, label)``."""
    return merge_labels(label_messages(labels, edges, hubs=hubs)).select("id", "label")
