"""N-gram Jaccard join with a token-group matrix.

Documents of equal shingle sets are one class.  Classes of one least shingle hash form a group with the
class that has the fewest tokens for itself as its leader (then least number); the members that reach the
threshold with the leader stay, the others are groups of their own.  The matrix has a row for each token and (block of a) group whose members hold it,
and the union of the tokens of each block.  A query class is looked up in the matrix; what its tokens have in
common with a block's union bounds the overlap with every member, and only blocks whose bound reaches
what the threshold needs are opened, i.e. compared member by member.

A set of n shingles has to share n - o + 1 of its tokens' first ones with any partner that it shares o
tokens with, in any order common to all sets.  So only these first tokens are looked up, rarest first:
the documents with a token are counted over all documents, for the quarter of all tokens of least hash
(all other tokens stand behind, by hash).  Most sets have enough tokens that no other set holds, and are
settled without being looked up at all.

Near copies of one text hold each other's first tokens, all of them.  The classes that meet at a crowded
token, one of more than ``CROWD`` classes, are counted once more, among themselves and by all their tokens.
What only one of them holds cannot be shared, so it shortens the list of first tokens and bounds the overlap
of a class with any other of the crowd.

Only components are asked for, so pairs within one component are left out: members and leaders first, then
at each token of a crowd the leader with the fewest tokens for itself and the others, leaders and leaders
next, then queries against the blocks of other components.  Leaders of a crowd meet by token and by the
sizes of both sets, where their bounds allow it and more than one component is left.  Pairs that stay in
different components although their bounds and first tokens allow a link are compared one by one, however
many they are.

Defined cases: NULL and empty texts, and those without words, have no shingles and are linked with
nothing; texts shorter than a shingle are one shingle as a whole; repeated rows are one class; the
component is named by the least id that is not NULL, rows with a NULL id take part (NULL if the component
has no other; without shingles: NULL); an empty table gives an empty frame; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from islets import connected_components
from islets.llm.hashing import U, chunks, mix, word_hashes
from islets.llm.shared import read, saved, scratch, settings

WIDTH, PERCENT = 4, 85
#: Tokens are 63 bits; those below this bound are counted over all documents.
COUNTED = 1 << 61
#: Members of a block of a group, on average at most.
BLOCK = 32
#: A token is crowded if more classes hold it: fewer may meet there in pairs.
CROWD = 32
#: Rows handed to Python at a time: each may carry the tokens of a whole block, and a default batch of them would
#: be as many times the block's size in memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n tokens with any set that reaches the threshold."""
    return (percent * n + 99) // 100


def least_overlap_of(n: Column, percent: int) -> Column:
    return F.floor((percent * n + 99) / 100)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens of all texts, sorted in each, and where each text's start (one more at the end)."""
    words, bounds = word_hashes([x.lower() for x in texts], lanes=True)
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    size = np.minimum(counts, width)[owner]
    found = mix(size.astype(U), 31)
    for j in range(width if len(owner) else 0):
        inside = size > j
        found[inside] = mix(found[inside] ^ words[at[inside] + j], 32)
    found >>= U(1)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(texts) + 1))


def _digests(found: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed tokens of each set: equal sets have equal ones."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (41, 42):
            sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(found, seed))))
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out


def sign(docs: DataFrame, *, width: int, percent: int, id_col: str, text: str, whole_sets: bool = False) -> DataFrame:
    """``id, n, d1, d2`` of each row, and its sorted ``tokens``: the counted ones, and more if that is too few.

    With ``whole_sets`` all tokens, as the bytes ``set``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 0, 1):
            found, bounds = shingle_sets(texts, width)
            n = np.diff(bounds)
            d1, d2 = _digests(found, bounds)
            rows = [pa.array(ids, pa.int64()), pa.array(n), pa.array(d1), pa.array(d2)]
            if whole_sets:
                sets = pa.array([found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows, sets], names=["id", "n", "d1", "d2", "set"])
                continue
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(found < U(COUNTED))))
            first = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
            taken = np.maximum(sums[bounds[1:]] - sums[bounds[:-1]], first)
            place = np.arange(len(found)) - np.repeat(bounds[:-1], n)
            tokens = found[place < np.repeat(taken, n)].astype(np.int64)
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(taken))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*rows, lists], names=["id", "n", "d1", "d2", "tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    last = "set binary" if whole_sets else "tokens array<long>"
    return chosen.mapInArrow(run, f"id long, n long, d1 long, d2 long, {last}")


def first_tokens(sets: DataFrame, work, percent: int) -> DataFrame:
    """``class, n, least, token``: the first tokens, rarest first, that other classes hold too; ``least`` is the least token."""
    listed = sets.select("class", "n", F.col("tokens")[0].alias("least"), F.explode("tokens").alias("token"))
    counts = saved(work, listed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    counted = F.col("token") < COUNTED
    shared = listed.join(counts, "token").select("class", F.struct((~counted).alias("behind"), F.when(counted, F.col("df")).alias("df"), "token").alias("t"))
    shared = shared.groupBy("class").agg(F.sort_array(F.collect_list("t")).alias("t"))
    sized = sets.select("class", "n", F.col("tokens")[0].alias("least"), F.size(F.filter("tokens", lambda x: x < COUNTED)).alias("all_counted"))
    joined = sized.join(shared, "class")
    first = F.col("n") - least_overlap_of(F.col("n"), percent) + 1
    alone = F.col("all_counted") - F.size(F.filter("t", lambda x: ~x.behind))
    wanted = F.when(F.col("all_counted") >= first, F.greatest(first - alone, F.lit(0))).otherwise(F.size("t"))
    return joined.select("class", "n", "least", F.explode(F.slice("t", F.lit(1), wanted.cast("int"))).alias("t")).select("class", "n", "least", "t.token")


def crowd_tokens(sets: DataFrame, work, percent: int) -> DataFrame:
    """``class, n, least, alone, tokens``: how many tokens no other of these classes holds, and the first tokens, rarest first.

    All tokens are counted, among the rows of ``sets`` (``class, set``) only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), U).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["class", "tokens"])

    listed = sets.select("class", "set").mapInArrow(run, "class long, tokens array<long>").select("class", F.explode("tokens").alias("token"))
    counts = saved(work, listed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "crowd-counts")
    shared = listed.join(counts, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    sized = sets.mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.as_py()) // 8 for x in b.column(1)], pa.int64()), pa.array([int.from_bytes(x.as_py()[:8], "little") for x in b.column(1)], pa.int64())], names=["class", "n", "least"])
            for b in batches
        ),
        "class long, n long, least long",
    )
    joined = sized.join(shared, "class", "left").withColumn("alone", F.col("n") - F.coalesce(F.size("t"), F.lit(0)))
    first = F.greatest(F.col("n") - least_overlap_of(F.col("n"), percent) + 1 - F.col("alone"), F.lit(0)).cast("int")
    tokens = F.transform(F.slice("t", F.lit(1), first), lambda x: x.token)
    return saved(work, joined.select("class", "n", "least", "alone", F.when(F.col("t").isNotNull(), tokens).alias("tokens")), "crowd-tokens")


def _overlaps(pairs: DataFrame) -> DataFrame:
    """``a, b, both, left_n, right_n`` of rows ``a, b, left, right`` (sorted tokens as bytes): overlap and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)) for x, y in zip(part.column(2), part.column(3))]
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
                sizes = [pa.array([len(pair[i]) for pair in sets], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int64()), *sizes], names=["a", "b", "both", "left_n", "right_n"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, both long, left_n long, right_n long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets reach the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("right"))
    found = _overlaps(pairs.join(left, "a").join(right, "b"))
    return found.where(100 * F.col("both") >= percent * (F.col("left_n") + F.col("right_n") - F.col("both"))).select("a", "b")


def _reach(n: Column, alone: Column, percent: int) -> Column:
    """``percent`` times the size of the largest set that one of ``n`` tokens can link with if ``alone`` of them are in no other."""
    return 100 * n - (100 + percent) * alone


def _fits(a_n: Column, a_reach: Column, b_n: Column, b_reach: Column, percent: int) -> Column:
    """Whether two sets can reach the threshold, by their sizes and the overlap that each can have at most."""
    return (a_reach >= percent * b_n) & (b_reach >= percent * a_n)


def _labels(links: DataFrame, work) -> DataFrame:
    found = connected_components(links, src="a", dst="b")
    return saved(work, found.select(F.col("id").alias("class"), "component"), "labels")


def _with_component(frame: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Add the ``component`` of ``key``; what has no link is its own."""
    named = labels.select(F.col("class").alias(key), "component")
    return frame.join(named, key, "left").withColumn("component", F.coalesce("component", key))


def _sets_of(docs: DataFrame, classes: DataFrame, *, width: int, percent: int, id_col: str, text: str) -> DataFrame:
    """``class, set`` of ``classes`` (rows ``class, d1, d2, first``), from the texts again."""
    ids = classes.where("first IS NOT NULL").select(F.col("first").alias("id"))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chosen = named.join(ids, "id", "left_semi").unionByName(named.where("id IS NULL"))
    found = sign(chosen, width=width, percent=percent, id_col="id", text="text", whole_sets=True)
    return found.join(classes.select("class", "d1", "d2"), ["d1", "d2"]).select("class", "set").dropDuplicates(["class"])


def _groups(members: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """``class, n, leader, m, block``: group, its size, block of it.

    ``links`` are pairs of a leader and a member; what is linked to no leader leads itself.
    """
    led = members.select("class", "n").join(links.select(F.col("a").alias("leader"), F.col("b").alias("class")), "class", "left")
    led = led.withColumn("leader", F.coalesce("leader", "class"))
    sizes = led.groupBy("leader").agg(F.count(F.lit(1)).alias("m"))
    parts = led.join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("m") / block)))
    # a block is named by its first member
    blocks = parts.groupBy("leader", "part").agg(F.min("class").alias("block"))
    return parts.join(blocks, ["leader", "part"]).select("class", "n", "leader", "m", "block")


def _others(held: DataFrame, *more: str) -> DataFrame:
    return held.select("token", *more, F.col("leader").alias("b"), F.col("n").alias("b_n"), F.col("reach").alias("b_reach"), F.col("component").alias("b_component"))


def _few_meet(held: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of leaders (rows ``token, leader, n, reach, component``) that meet at a token of ``CROWD`` classes at most."""
    held = held.where("token >= 0")
    apart = (F.col("leader") < F.col("b")) & (F.col("component") != F.col("b_component"))
    pairs = held.join(_others(held), "token").where(apart & _fits(F.col("n"), F.col("reach"), F.col("b_n"), F.col("b_reach"), percent))
    return pairs.select(F.col("leader").alias("a"), "b")


def _crowds_meet(held: DataFrame, work, percent: int) -> DataFrame:
    """Pairs ``a, b`` of leaders that meet at a token of a crowd.

    A leader asks at each of its tokens for the sizes that it fits with; only what asks for each other's size is
    paired, and only where more than one component does.
    """
    held = held.where("token < 0")
    sizes = held.groupBy("token", F.col("n").alias("other")).agg(F.max("reach").alias("most"))
    asks = held.join(sizes, "token").where(_fits(F.col("n"), F.col("reach"), F.col("other"), F.col("most"), percent))
    asks = asks.withColumns({"low": F.least("n", "other"), "high": F.greatest("n", "other")}).drop("most", "other")
    asks = saved(work, asks, "asks")
    meet = ["token", "low", "high"]
    open_ = asks.groupBy(*meet).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(*meet)
    asks = saved(work, asks.join(open_, meet, "left_semi"), "open")
    apart = F.col("component") != F.col("b_component")
    once = (F.col("low") < F.col("high")) | (F.col("leader") < F.col("b"))
    return asks.where("n = low").join(_others(asks.where("n = high"), "low", "high"), meet).where(apart & once & _fits(F.col("n"), F.col("reach"), F.col("b_n"), F.col("b_reach"), percent)).select(F.least("leader", "b").alias("a"), F.greatest("leader", "b").alias("b"))


def _unions(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``block, union`` of rows ``class, block``: the tokens of all members of a block, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                unions = [np.unique(np.concatenate([np.frombuffer(x, U) for x in held])).tobytes() for held in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(unions, pa.binary())], names=["block", "union"])

    gathered = members.join(sets, "class").groupBy("block").agg(F.collect_list("set").alias("sets"))
    return gathered.mapInArrow(run, "block long, union binary")


def jaccard_components(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id``.

    Two documents link if their sets of ``width``-word shingles have a Jaccard similarity of ``percent``
    or more; the component is the least id reachable by links.
    """
    with settings(docs.sparkSession, BATCH):  # every job with Python runs in here
        return _jaccard_components(docs, width, percent, block, id_col, text)


def _jaccard_components(docs: DataFrame, width: int, percent: int, block: int, id_col: str, text: str) -> DataFrame:
    work = scratch(docs.sparkSession, "token-groups")
    signed = sign(docs, width=width, percent=percent, id_col=id_col, text=text)
    signed = saved(work, signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    some = signed.where("n > 0")
    classes = saved(work, some.groupBy("d1", "d2").agg(F.min("row").alias("class"), F.min("id").alias("first")), "classes")
    # a class stands for its rows; the others are left out by their numbers, without a shuffle of token lists
    copies = saved(work, some.select("row", "d1", "d2").join(classes, ["d1", "d2"]).where("row <> class").select("row"), "copies")
    sets = some.join(copies, "row", "left_anti").select(F.col("row").alias("class"), "n", "tokens")
    entries = saved(work, first_tokens(sets, work, percent), "entries")
    met = saved(work, entries.select("class").distinct(), "met")
    sets = saved(work, _sets_of(docs, classes.join(met, "class", "left_semi"), width=width, percent=percent, id_col=id_col, text=text), "sets")

    # crowds, by the tokens of their own: as negative numbers, which stand apart from the others
    crowded = saved(work, entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > CROWD).select("token"), "crowded")
    crowd = saved(work, entries.join(crowded, "token", "left_semi").select("class").distinct(), "crowd")
    crowd = crowd_tokens(sets.join(crowd, "class", "left_semi"), work, percent)
    plain = entries.join(crowded, "token", "left_anti").select("class", "n", "least", F.lit(0).cast("long").alias("alone"), "token")
    own = crowd.select("class", "n", "least", "alone", F.explode("tokens").alias("token"))
    entries = plain.unionByName(own.withColumn("token", F.bitwise_not("token")))
    entries = saved(work, entries.withColumn("reach", _reach(F.col("n"), F.col("alone"), percent)), "all-entries")
    members = entries.select("class", "n", "least").distinct().join(crowd.select("class", "alone"), "class", "left")
    members = saved(work, members, "members")  # alone: NULL outside crowds

    # groups: the classes of one least token that reach the threshold with the first of them
    leaders = members.groupBy("least").agg(F.min(F.struct("alone", "class", "n")).alias("leader"))
    sizes_fit = _fits(F.col("n"), 100 * F.col("n"), F.col("leader.n"), 100 * F.col("leader.n"), percent)
    near = members.join(leaders, "least").where((F.col("class") != F.col("leader.class")) & sizes_fit)
    links = saved(work, linked(near.select(F.col("leader.class").alias("a"), F.col("class").alias("b")), sets, percent), "links")
    groups = saved(work, _groups(members, links, block), "groups")

    # the matrix, for the tokens that more than one group holds
    matrix = entries.select("token", "class", "alone", "reach").join(groups, "class")
    met = matrix.groupBy("token").agg(F.min("leader").alias("a"), F.max("leader").alias("b")).where("a <> b").select("token")
    matrix = saved(work, matrix.join(saved(work, met, "met"), "token", "left_semi"), "matrix")

    # the leaders of crowds against the first of them at each token
    held = matrix.where("class = leader").select("token", "leader", "n", "alone", "reach")
    first = held.where("token < 0").groupBy("token").agg(F.min(F.struct("alone", "leader", "n", "reach")).alias("x"))
    stars = held.join(first, "token").where((F.col("leader") != F.col("x.leader")) & _fits(F.col("n"), F.col("reach"), F.col("x.n"), F.col("x.reach"), percent))
    stars = saved(work, stars.select(F.col("x.leader").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    links = links.unionByName(saved(work, linked(stars, sets, percent), "links"))
    labels = _labels(links, work)

    # leaders against leaders of other components
    held = saved(work, _with_component(held, labels, "leader").select("token", "leader", "n", "reach", "component"), "leaders")
    pairs = saved(work, _few_meet(held, percent).unionByName(_crowds_meet(held, work, percent)).distinct(), "pairs")
    links = links.unionByName(saved(work, linked(pairs, sets, percent), "links"))
    labels = _labels(links, work)

    # queries against the blocks of the groups before their own, if these belong to other components
    x = matrix.select("token", F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("reach").alias("a_reach"), F.col("leader").alias("a_leader"), F.col("m").alias("a_m"))
    x = _with_component(x, labels, "a_leader").withColumnRenamed("component", "a_component")
    held = matrix.groupBy("token", "block", "leader", "m").agg(F.min("n").alias("low"), F.max("reach").alias("reach"))
    held = _with_component(held, labels, "leader")
    apart = (F.col("leader") < F.col("a_leader")) & (F.col("component") != F.col("a_component"))
    # two groups of one member each have met as leaders
    open_ = apart & ((F.col("m") > 1) | (F.col("a_m") > 1)) & _fits(F.col("a_n"), F.col("a_reach"), F.col("low"), F.col("reach"), percent)
    asked = saved(work, x.join(held, "token").where(open_).select("a", "block").distinct(), "asked")
    in_blocks = groups.join(asked.select("block").distinct(), "block", "left_semi").select("class", "n", "block")
    unions = saved(work, _unions(in_blocks.select("class", "block"), sets), "unions")
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("left"))
    bounds = _overlaps(asked.join(left, "a").join(unions.withColumnRenamed("union", "right"), "block").withColumnRenamed("block", "b"))
    opened = bounds.where(F.col("both") >= least_overlap_of(F.col("left_n"), percent)).select("a", F.col("left_n").alias("a_n"), F.col("b").alias("block"))
    alone = members.select("class", "alone")
    opened = opened.join(alone.withColumnsRenamed({"class": "a", "alone": "a_alone"}), "a").join(in_blocks.join(alone, "class"), "block")
    crowded = F.col("a_alone").isNotNull() & F.col("alone").isNotNull()  # what one of a crowd holds alone others may hold
    a_reach, reach = (_reach(F.col(n), F.when(crowded, F.col(of)).otherwise(0), percent) for n, of in (("a_n", "a_alone"), ("n", "alone")))
    opened = opened.where(_fits(F.col("a_n"), a_reach, F.col("n"), reach, percent)).select("a", F.col("class").alias("b"))
    links = links.unionByName(saved(work, linked(saved(work, opened, "opened"), sets, percent), "links"))

    named = _with_component(classes, _labels(links, work), "class")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = saved(work, named.join(least, "component").select("d1", "d2", "component_id"), "named")
    found = signed.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Pairs of different sets that share a shingle, counted in full.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) END AS s
  FROM w
),
c AS (SELECT s, min(doc_id) AS c, CAST(len(s) AS BIGINT) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT c, n, unnest(s) AS token FROM c),
often AS (SELECT token FROM t GROUP BY token HAVING count(*) > 1),
k AS (SELECT c, n, token FROM t SEMI JOIN often USING (token)),
-- a set that shares too few tokens with all others has no link
live AS (SELECT c, n, token FROM k QUALIFY 100 * count(*) OVER (PARTITION BY c) >= 85 * n),
e AS (
  SELECT x.c AS a, y.c AS b FROM live x JOIN live y ON x.token = y.token AND x.c < y.c
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, l) USING KEY (v) AS (
  SELECT c, c FROM c
  UNION
  SELECT x.b, min(r.l) FROM r JOIN both_ways x ON x.a = r.v JOIN recurring.r k ON k.v = x.b WHERE r.l < k.l GROUP BY x.b
)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.l, doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s AND len(s.s) > 0 LEFT JOIN r ON r.v = c.c
"""
