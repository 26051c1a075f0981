"""Mixing sources to target weights: hierarchical budgeting, in DataFrame functions only.

Weights are propagated from the root through the levels of a tree (here domain, language, source).
At each node the budget is shared among the children by weight; a child that cannot fill its share,
even with all epochs, gets what it has, and the shortage goes to its siblings.  Only what a whole
family cannot fill is left to the siblings of its parent, since a node's own limit is the sum of its
leaves.  Each leaf then takes documents in seeded order, epoch after epoch, as long as the sum of
tokens stays within its budget: whole epochs first, then a prefix of the last one.

Nothing is sorted as a whole.  Order keys are hashes; tokens are summed by slices of the key space,
and only the slice in which a leaf's prefix ends is looked at row by row.  The choice of a leaf is
one row (whole epochs, last key of the prefix), so the documents are not shuffled to be chosen.

Defined cases: NULL text has no tokens; NULL levels are nodes of their own; NULL ids share one key;
rows with equal keys (repeated rows) are taken together or not at all; a document without tokens is
taken with the first prefix or epoch that reaches its key; weights that are missing count 1, and
weights of 0 or less get nothing; an empty table gives an empty frame; clashing names are avoided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from islets.llm.shared import read, safe_name, saved, scratch, whole, without_space, words

#: Slices of the key space; the row-wise part of a leaf is about its rows / SLICES.
SLICES = 4096


def _node(columns: Sequence[Column]) -> Column:
    """A key for the path to a node; NULL and any string stay apart."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))


def _order(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), id_col)


def _slice(order: Column) -> Column:
    return F.shiftright(order, 52).cast("int")


def _share(nodes: DataFrame) -> DataFrame:
    """Budgets of children: ``parent, node, budget (of the parent), weight, limit`` to ``node, got``.

    Children are filled in the order of limit / weight; those before the first that can take its
    proportional share of what is left are full.
    """
    usable = F.when((F.col("weight") > 0) & (F.col("limit") > 0), F.col("weight")).otherwise(0.0)
    ratio = F.when(F.col("w") > 0, F.col("limit") / F.col("w"))
    upto = Window.partitionBy("parent").orderBy(F.col("ratio").asc_nulls_last(), "node")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    onwards = upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent = F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("limit"))).over(before), F.lit(0.0))
    rest = F.sum("w").over(onwards)
    level = (F.col("budget") - F.col("spent")) / F.col("rest")
    # the first child that is not full fixes the level for it and all after it
    first = F.min(F.when((F.col("w") > 0) & (level < F.col("ratio")), F.struct("ratio", "node", level.alias("level")))).over(
        Window.partitionBy("parent")
    )
    return (
        nodes.withColumn("w", usable)
        .withColumn("ratio", ratio)
        .withColumn("spent", spent)
        .withColumn("rest", rest)
        .withColumn("first", first)
        .select(
            "node",
            F.when(F.col("w") == 0, 0.0)
            .when(F.col("first").isNull() | (F.struct("ratio", "node") < F.struct("first.ratio", "first.node")), F.col("limit"))
            .otherwise(F.col("w") * F.col("first.level"))
            .alias("got"),
        )
    )


def leaf_budgets(
    sizes: DataFrame, levels: Sequence[str], *, budget: Column, max_epochs: int, weights: DataFrame | None = None
) -> DataFrame:
    """Tokens for each leaf.  ``sizes``: the levels and ``tokens``, one row per leaf.

    ``weights`` has one row per weighted node: ``path`` (array of the level values as strings) and
    ``weight``; nodes without a row weigh 1.  Gives ``leaf, tokens, budget``.
    """
    columns = [F.col(name) for name in levels]
    leaves = sizes.select(
        *[_node(columns[:i]).alias(f"n{i}") for i in range(len(levels) + 1)],
        "tokens",
        (F.col("tokens") * float(max_epochs)).alias("limit"),
    )
    got = leaves.groupBy("n0").agg(F.sum("limit").alias("limit"), F.sum("tokens").alias("tokens")).select(
        F.col("n0").alias("node"), F.least(budget.cast("double"), F.col("limit")).alias("got")
    )
    if weights is not None:
        weights = weights.select(F.to_json("path").alias("node"), F.col("weight").cast("double").alias("weight"))
    for depth in range(1, len(levels) + 1):
        nodes = leaves.groupBy(F.col(f"n{depth - 1}").alias("parent"), F.col(f"n{depth}").alias("node")).agg(F.sum("limit").alias("limit"))
        nodes = nodes.join(got.select(F.col("node").alias("parent"), F.col("got").alias("budget")), "parent")
        nodes = nodes.withColumn("weight", F.lit(1.0)) if weights is None else nodes.join(weights, "node", "left").fillna(1.0, ["weight"])
        got = _share(nodes)
    return leaves.select(F.col(f"n{len(levels)}").alias("leaf"), "tokens").join(got.withColumnRenamed("node", "leaf"), "leaf").select(
        "leaf", "tokens", F.floor("got").cast("long").alias("budget")
    )


def mixture(
    docs: DataFrame,
    levels: Sequence[Column],
    *,
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 17,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The rows with ``copies`` (epochs that take the row, 0 for none), and the plan of each leaf.

    The budget is ``share`` of all tokens, at most ``max_epochs`` passes over a leaf.  A token is a
    word.  The plan: ``leaf, tokens, budget, whole_epochs, last_order, last_id``.
    """
    spark = docs.sparkSession
    work = scratch(spark, "mixing")
    names = [f"level{i}" for i in range(len(levels))]
    slim = saved(
        work,
        docs.select(
            F.col(id_col).alias("id"),
            *[level.cast("string").alias(name) for level, name in zip(levels, names)],
            F.size(words(whole(text))).cast("long").alias("tokens"),
        ),
        "tokens",
    )
    sizes = saved(work, slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = sizes.agg(F.sum("tokens").alias("t")).select((F.coalesce("t", F.lit(0)) * share).alias("budget"))
    budget = float(total.first().budget)  # one number
    plan = saved(work, leaf_budgets(sizes, names, budget=F.lit(budget), max_epochs=max_epochs, weights=weights), "budgets")
    tokens = F.greatest(F.col("all_tokens"), F.lit(1))
    plan = plan.withColumnRenamed("tokens", "all_tokens").withColumns(
        {
            "whole_epochs": F.when(F.col("all_tokens") > 0, F.floor(F.col("budget") / tokens)).otherwise(0).cast("long"),
        }
    )
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole_epochs") * F.col("all_tokens"))
    # rows keyed for the epoch that is taken in part
    keyed = slim.withColumn("leaf", _node([F.col(n) for n in names])).join(plan.select("leaf", "whole_epochs", "rest"), "leaf")
    keyed = keyed.withColumn("order", _order(seed, F.col("whole_epochs"), F.col("id"))).withColumn("slice", _slice(F.col("order")))
    slices = keyed.groupBy("leaf", "slice").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    running = Window.partitionBy("leaf").orderBy("slice")
    slices = slices.withColumn("upto", F.sum("n").over(running))
    # the slice in which the prefix ends; without one the prefix is the whole epoch
    edge = slices.where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(
        F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("edge")
    )
    edge = saved(work, edge.select("leaf", F.col("edge.slice").alias("slice"), F.col("edge.before").alias("before")), "edges")
    rows = keyed.join(edge, ["leaf", "slice"])
    # peers of equal key are summed together
    inside = rows.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf", "slice").orderBy("order", F.col("id").asc_nulls_first())))
    last = inside.where(F.col("upto") <= F.col("rest")).groupBy("leaf").agg(F.max(F.struct("order", "id")).alias("last"))
    plan = (
        plan.join(edge.select("leaf", "slice"), "leaf", "left")
        .join(last, "leaf", "left")
        .select("leaf", F.col("all_tokens").alias("tokens"), "budget", "whole_epochs", F.col("slice").alias("edge_slice"), F.col("last.order").alias("last_order"), F.col("last.id").alias("last_id"))
    )
    plan = saved(work, plan, "plan")
    taken = {c: safe_name(docs, c + "__") for c in ("leaf", "whole_epochs", "edge_slice", "last_order", "last_id")}
    cut = plan.select(*[F.col(c).alias(n) for c, n in taken.items()])
    order = _order(seed, F.col(taken["whole_epochs"]), F.col(id_col))
    edge_slice, last_order, last_id = (F.col(taken[c]) for c in ("edge_slice", "last_order", "last_id"))
    id_ = F.col(id_col)
    in_prefix = (
        edge_slice.isNull()
        | (_slice(order) < edge_slice)
        | (last_order.isNotNull() & ((order < last_order) | ((order == last_order) & (id_.isNull() | (id_ <= last_id)))))
    )
    more = F.col(taken["whole_epochs"]) < max_epochs
    copies = F.col(taken["whole_epochs"]) + F.when(more & F.coalesce(in_prefix, F.lit(False)), 1).otherwise(0)
    chosen = docs.join(cut, _node([level for level in levels]) == cut[taken["leaf"]]).withColumn("copies", copies.cast("int"))
    return chosen.drop(*taken.values()), plan


def domain(source: Column) -> Column:
    """The domain of a source of ``documents``: five domains by a hash of the source's name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(5)))


def levels_of_documents() -> list[Column]:
    return [domain(F.col("source")), F.col("lang"), F.col("source")]


#: Production parameters.
SHARE, EPOCHS, SEED = 0.7, 2, 17


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows, _ = mixture(docs, levels_of_documents(), share=SHARE, max_epochs=EPOCHS, seed=SEED)
    return rows.select("doc_id", domain(F.col("source")).alias("domain"), "lang", "source", "copies")
