"""Exact dedup: stateful streaming deduplication.

Arrivals flow through a structured stream.  Its keyed state lives in RocksDB on the executors' disks
(checkpointed to the shared folder), has no watermark and so never expires, and keeps per digest of
the normalised text: the stable identifier of the row that stays, a locator of its content, and the
size of the group.  Hits, that is rows whose digest has been seen, are then checked on full bytes:
the texts of each group of two or more are fetched through their locators and must be one text;
should a digest ever stand for several texts, its group is split by the texts themselves.

Defined cases: NULL text counts as the empty text; of equal texts the row with the most code points
in the original stays, then the least id, NULL ids last; rows with the same id, text and length are
one document given twice: ``kept`` is true on each of them, ``group_size`` counts the rows; an empty
table gives an empty frame.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm.shared import read, saved, scratch, whole, without_space

STATE = "spark.sql.streaming.stateStore."
#: Settings of the stream: state on disk, checkpointed by its changes, and closed after each batch, so
#: that executors hold no files and memory of partitions that they do not work on.
SETTINGS = {
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE + "rocksdb.changelogCheckpointing.enabled": "true",
    STATE + "unloadOnCommit": "true",
}

#: Parts into which the check of one group is split.
SALTS = 32


@contextmanager
def _disk_backed_state(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrivals(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What the stream sees of each row: id, digest, original length and locator; no text."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(without_space(whole(text)), 256).alias("digest"),
        F.length(whole(text)).cast("long").alias("chars"),
        F.xxhash64(whole(text)).alias("locator"),
    )


def fold(spark: SparkSession, landing: str, state: str, out: str, files_per_trigger: int) -> DataFrame:
    """Run the stream over all files that have landed; one row per digest.

    Calling it again after more files have landed goes on from the state in ``state``; a batch that
    is repeated after a failure overwrites its own folder.
    """
    arrived = (
        spark.readStream.schema("id long, digest string, chars long, locator long")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(landing)
    )
    # a struct orders by its fields, so the greatest one is the row that stays
    groups = arrived.groupBy("digest").agg(
        F.max(F.struct("chars", (-F.col("id")).alias("order"), "locator")).alias("stays"), F.count(F.lit(1)).alias("size")
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.lit(number).cast("long").alias("batch"), "digest", "stays", "size").write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _disk_backed_state(spark):
        stream = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        stream.awaitTermination()
    schema = "digest string, stays struct<chars: long, order: long, locator: long>, size long, batch long"
    seen = spark.read.schema(schema).parquet(out)
    return seen.groupBy("digest").agg(F.max(F.struct("batch", "stays", "size")).alias("last")).select("digest", "last.stays", "last.size")


def stateful_dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", files_per_trigger: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.  Ids are integers."""
    spark = docs.sparkSession
    work = scratch(spark, "exact-dedup")
    landed = saved(work, arrivals(docs, id_col=id_col, text=text).withColumn("id", F.col("id").cast("long")), "arrivals")
    landing = landed.inputFiles()[0].rsplit("/", 1)[0] if landed.inputFiles() else None
    if landing is None or landed.isEmpty():
        return landed.select("id", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    groups = fold(spark, landing, f"{work.folder}/state", f"{work.folder}/groups", files_per_trigger)
    groups = saved(work, groups, "digests")
    # full bytes on hits: every group of two or more must hold one text
    # (spread over SALTS parts, each combined before it is shuffled, so a hot group is not one task)
    hits = groups.where("size > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    texts = docs.select(
        without_space(whole(text)).alias("body"), (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt")
    ).withColumn("digest", F.sha2("body", 256))
    broken = (
        texts.join(hits, ["digest", "salt"], "left_semi")
        .groupBy("digest")
        .agg(F.min("body").alias("least"), F.max("body").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("digest")
    )
    if saved(work, broken, "split").isEmpty():
        members = landed.join(groups, "digest")
    else:  # one digest, several texts: group these rows by the texts themselves
        members = _by_text(docs, id_col, text)
    keep = -F.col("stays.order")
    same = F.struct("chars", (-F.col("id")).alias("order"), "locator").eqNullSafe(F.col("stays"))
    return members.select(
        "id", keep.alias("keep_id"), F.col("size").alias("group_size"), same.alias("kept"), F.col("digest").alias("text_sha256")
    )


def _by_text(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), without_space(whole(text)).alias("body"), F.length(whole(text)).cast("long").alias("chars"), F.xxhash64(whole(text)).alias("locator")
    )
    groups = rows.groupBy("body").agg(
        F.max(F.struct("chars", (-F.col("id")).alias("order"), "locator")).alias("stays"), F.count(F.lit(1)).alias("size")
    )
    return rows.join(groups, "body").withColumn("digest", F.sha2("body", 256))


def query(spark, sf_dir):
    found = stateful_dedup(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents
),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
