"""Tables that cut the lineage between rounds.

Each round ends in a parquet table below the shared folder that the session names in
``spark.checkpoint.dir``.  A lost executor then costs the tasks it ran, never the rounds before; the
next round plans from a plain scan with known size, so Spark can size joins and partitions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Rows for one task at least, before a table is dealt to more tasks than there are cores.
TASK_ROWS = 50_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for round tables, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(
            "set spark.checkpoint.dir to a folder that all executors share, such as one on HDFS"
        )
    spark.sparkContext.setCheckpointDir("file:" + tempfile.mkdtemp(prefix="islets-"))
    return spark.sparkContext.getCheckpointDir()


@dataclass
class Table:
    """A written frame, its row count, and what was counted while it was written."""

    frame: DataFrame
    path: str
    rows: int
    counts: dict[str, int] = field(default_factory=dict)
    name: str | None = None


class Workspace:
    """A folder of round tables for one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._written = 0

    def save(
        self,
        frame: DataFrame,
        name: str,
        *,
        drop: tuple[str, ...] = (),
        buckets: tuple[str, int] | None = None,
        about: int | None = None,
        **counts: Column,
    ) -> Table:
        """Write a frame in one job that also counts its rows and evaluates ``counts``.

        ``counts`` are aggregates, NULL counting as 0.  Columns in ``drop`` are counted but not
        written.  Counting takes place in the tasks that write, whose
        results Spark takes once each even if tasks or executors fail.  ``buckets`` is a key and a
        number: the rows are kept in that many buckets by hash of the key, and joins on the key with
        what is partitioned alike shuffle neither side.  ``about`` is how many rows are worked on, where
        that is known: a small table is then written by as many tasks as there are cores, also in sessions
        whose shuffles keep to a fixed number of partitions.
        """
        self._written += 1
        path = f"{self.folder}/{self._written:04d}-{name}"
        seen = Observation()
        metrics = [F.count(F.lit(1)).alias("rows")]
        metrics += [value.alias(key) for key, value in counts.items()]
        out = frame.observe(seen, *metrics).drop(*drop)
        listed = None
        if buckets is None:
            if about is not None:
                out = out.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-about // TASK_ROWS)))
            out.write.parquet(path)
            table = self.spark.read.schema(out.schema).parquet(path)
        else:
            listed = self._create(out, path, *buckets)
            out.write.insertInto(listed)
            table = self.spark.table(listed)
        try:
            found = {key: value or 0 for key, value in seen.get.items()}
        except Exception:  # no metrics: only a frame that the optimizer proved empty drops the counter
            if not table.isEmpty():
                raise
            found = {}
        rows = found.pop("rows", 0)
        return Table(table, path, rows, {key: found.get(key, 0) for key in counts}, listed)

    def _create(self, frame: DataFrame, path: str, key: str, buckets: int) -> str:
        """An empty table in buckets; buckets are known to the catalog only, not to the files."""
        name = f"islets_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        place = path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        return name

    def unlist(self, table: Table) -> DataFrame:
        """The rows of a table as plain files; the catalog forgets it."""
        if table.name is None:
            return table.frame
        frame = self.spark.read.schema(table.frame.schema).parquet(table.path)
        self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        return frame

    def drop(self, table: Table) -> None:
        """Delete a table that no later step reads."""
        if table.name is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.path)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(path, True)
