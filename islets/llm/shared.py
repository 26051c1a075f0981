"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.plans.workspace import Workspace

#: White space of every word rule here: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> Workspace:
    """A folder for intermediate tables below ``spark.checkpoint.dir``.

    Also names this package's folder to Python workers, for sessions that found it by ``sys.path``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return Workspace(spark, name)


def saved(work: Workspace, frame: DataFrame, name: str, about: int | None = None) -> DataFrame:
    """Write a frame and read it back, so that its rows and ids stay as they are; ``about`` as in ``Workspace.save``."""
    return work.save(frame, name, about=about).frame


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Jobs inside run with these settings of the session."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def whole(text: str = "text") -> Column:
    """The text, NULL as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def safe_name(frame: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {name.lower() for name in frame.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
