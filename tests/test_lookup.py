"""The hub-safe join gives what a plain join gives, and keeps hub rows off the shuffle."""

import pytest
from pyspark.sql import functions as F

from islets.operators.lookup import Hubs, lookup


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        F.col("id").alias("v"),
    )
    table = spark.range(0, 90).select((F.col("id") * 2).alias("k"), (F.col("id") + 5).alias("w"))
    return rows, table


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [0, 25, 500, 10_000])
def test_same_rows_as_a_plain_join(frames, how, limit):
    rows, table = frames
    plain = rows.join(table, "k", how)
    split = lookup(rows, table, "k", Hubs(limit), how)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0
    assert split.count() == plain.count()


def test_hub_missing_from_the_table(spark, frames):
    rows, table = frames
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    without = table.where("k <> 0")
    split = lookup(rows, without, "k", Hubs(500), "inner", counts)
    assert split.count() == rows.join(without, "k").count()


def test_per_key_frames_can_be_kept(frames):
    rows, table = frames
    seen = []
    lookup(rows, table, "k", Hubs(500, lambda frame: seen.append(frame) or frame))
    assert len(seen) == 1 and seen[0].count() == 1


def test_rows_of_hubs_are_not_shuffled(spark, frames, tmp_path):
    rows, table = frames
    rows.write.parquet(str(tmp_path / "rows"))
    table.write.parquet(str(tmp_path / "table"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "table"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        split = lookup(rows, table, "k", Hubs(500))
        plan = split._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("SortMergeJoin") == 1
    assert "BroadcastHashJoin" in physical and "LeftAnti" in physical
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical
