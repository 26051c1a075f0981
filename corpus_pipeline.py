"""A corpus pipeline made of the text operators.

Each stage takes the documents that its predecessor kept, as written and read again.  NULL texts are empty
and fail the quality rules; NULL sources are a source like others; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm import dart_minhash, exact_dedup, mixing, packing, quality_rules
from islets.llm.shared import saved, scratch, whole, without_space

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject, and the frequent lines of the others.

    Verdicts and clean texts are written before they are filtered: a filter right on top of them would
    make Spark work out every rule again for each column that is used.
    """
    judged = quality_rules.line_frequency_rules(docs).select("doc_id", "clean_text", "lang", "source", "kept")
    judged = saved(scratch(spark, "rules"), judged, "judged").where("kept")
    n_chars = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: of a row given several times, one; a NULL id is an id like others.

    Rows of one id and one text stand for one another; they are combined before they are shuffled, so a hot row is not
    one task's, and the verdicts are joined where the combined rows lie: texts are shuffled once here.
    """
    id_key = lambda id: (F.coalesce(id, F.lit(0)).alias("id__"), id.isNull().alias("null__"))
    keys = ["id__", "null__", "digest__"]
    verdicts = exact_dedup.stateful_dedup(docs).where("kept")
    kept = verdicts.select(*id_key(F.col("id")), F.col("text_sha256").alias("digest__")).distinct()
    # of equal texts the longest original, as the verdict wants
    row = F.struct((-F.length(whole())).alias("less__"), *COLUMNS[1:], "doc_id")
    own = docs.select(*id_key(F.col("doc_id").cast("long")), F.sha2(without_space(whole()), 256).alias("digest__"), row.alias("row__"))
    one = own.groupBy(*keys).agg(F.min("row__").alias("row__"))
    return one.join(kept, keys, "left_semi").select(*(F.col(f"row__.{c}").alias(c) for c in COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near duplicates; rows without an id stay.

    Rows that share an id are told apart by nothing here and go or stay together; equal ones are gone by now.
    """
    groups = dart_minhash.near_duplicates(docs)
    kept = groups.where(F.col("id").isNull() | (F.col("id") == F.col("group_id"))).select("id").distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each leaf's share of the token budget; a document taken twice is two rows."""
    rows, _ = mixing.mixture(docs, mixing.levels_of_documents(), share=mixing.SHARE, max_epochs=mixing.EPOCHS, seed=mixing.SEED)
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack(docs, packing.tokenizer_path()).withColumnRenamed("id", "doc_id")


#: Rows with stages that SQL cannot express (near duplicates, packing), so there is no SQL.
ORACLE_SQL = None

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(work, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
