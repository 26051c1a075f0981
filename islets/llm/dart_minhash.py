"""MinHash near-dedup with DartMinHash.

A weighted element is a strip in a plane of weight and rank.  Darts are thrown at the plane by
hashing: each cell of a dyadic grid gets a number of darts, their places and their coordinates from
the hash of (element, cell), so all documents see the same darts.  A document keeps the darts that
fall below the weights of its elements; per coordinate the dart of least rank is its signature.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Ranks beyond t / (sum of weights) are never looked at, so a signature costs time near
elements + coordinates * log(coordinates) instead of their product.

The job: texts equal in words form one class; classes are signed and banded; in each bucket every
member is tested against the bucket's first member, later against all members of other components;
links are verified on whole shingle sets; classes linked over any path form one group.

Defined cases: NULL text counts as empty; texts of fewer words than a shingle are one shingle;
texts without words are alike and form one class; ties are broken by the least id; rows that repeat
an id and a text stay rows of one class; an empty table gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from islets import connected_components
from islets.llm.hashing import U, Windows, chunks, mix, word_hashes
from islets.llm.shared import read, saved, scratch, whole

#: Cells of the grid in rank: [0, 2**LOW), then doubling.
LOW = -7
#: Members of a bucket's largest component that each member outside it is tested against first.
SAMPLE = 8
#: Bits of an odd sketch.
ODD = 512
#: A row with a shingle set weighs as much as so many rows of numbers.
SET_ROWS = 25
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, rank_limit: np.ndarray, k: int):
    """The darts below the weights and the rank limit of each element's owner.

    Gives owner, coordinate, rank, name of each dart.  Cells are cut into unit areas, each with a
    Poisson(1) number of darts.
    """
    out = []
    top = rank_limit[owner]
    weight_level = 0
    while True:  # weight cells [0, 1), [1, 2), [2, 4), ...
        w0, w1 = (0.0, 1.0) if weight_level == 0 else (2.0 ** (weight_level - 1), 2.0**weight_level)
        rows = np.flatnonzero(weights > w0)
        if not len(rows):
            break
        rank_level = 0
        while len(rows):
            r0, r1 = (0.0, 2.0**LOW) if rank_level == 0 else (2.0 ** (LOW + rank_level - 1), 2.0 ** (LOW + rank_level))
            rows = rows[top[rows] > r0]
            if not len(rows):
                break
            area = (w1 - w0) * (r1 - r0)
            pieces = max(1, int(area))
            for piece in range(pieces):
                cell = mix(elements[rows], (weight_level << 40) | (rank_level << 32) | piece)
                if area >= 1:
                    count = np.searchsorted(_POISSON, _unit(cell))
                else:  # the Poisson distribution of a small area
                    levels = np.cumsum([np.exp(-area) * area**n / np.prod(np.arange(1, n + 1, dtype=float)) for n in range(8)])
                    count = np.searchsorted(levels, _unit(cell))
                some = np.flatnonzero(count)
                which = np.repeat(some, count[some])
                if not len(which):
                    continue
                number = np.arange(len(which)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                name = mix(cell[which] + number.astype(U), 1)
                step = (r1 - r0) / pieces
                rank = r0 + (piece + _unit(mix(name, 2))) * step
                weight = w0 + _unit(mix(name, 3)) * (w1 - w0)
                coordinate = (mix(name, 4) % U(k)).astype(np.int64)
                row = rows[which]
                ok = (weight < weights[row]) & (rank < top[row])
                out.append((owner[row][ok], coordinate[ok], rank[ok], name[ok]))
            rank_level += 1
        weight_level += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n documents; a document without elements gets zeros."""
    total = np.bincount(owner, weights, n)
    result = np.zeros((n, k), U)
    open_ = total > 0
    reach = k * (np.log(k) + 2.0)
    while open_.any():
        limit = np.where(open_, reach / np.maximum(total, 1e-300), 0.0)
        mine = open_[owner]
        who, coordinate, rank, name = darts(elements[mine], weights[mine], owner[mine], limit, k)
        order = np.argsort(rank, kind="stable")[::-1]
        slots = np.full(n * k, -1, np.int64)
        slots[(who * k + coordinate)[order]] = order  # the last written is the one of least rank
        slots = slots.reshape(n, k)
        full = (slots >= 0).all(axis=1) & open_
        result[full] = name[slots[full]]
        open_ &= ~full
        reach *= 2.0
    return result


def shingles(texts: list[bytes], width: int, weighted: bool = False):
    """Distinct shingles of each text: hashes, weights, owner; sorted by owner and hash."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    found = Windows(words).hash(starts, np.minimum(counts, width)[owner])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    weights = np.diff(np.append(at, len(found))).astype(float) if weighted else np.ones(len(at))
    return found[at], weights, owner[at]


def sign(docs: DataFrame, *, width: int, bands: int, rows: int, weighted: bool, id_col: str, text: str) -> DataFrame:
    """``id, d1, d2`` (digest of the words), ``n`` (shingles), ``bands`` (one hash each) of each row."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 0, 1, 1 << 20):
            found, weights, owner = shingles(texts, width, weighted)
            signed = signatures(found, weights, owner, len(texts), k)
            keys = np.zeros((len(texts), bands), U)
            for r in range(rows):
                keys = mix(keys ^ signed[:, r::rows][:, :bands], r)
            n = np.bincount(owner, minlength=len(texts))
            # equal words give equal digests
            words, bounds = word_hashes(texts)
            whole_text = Windows(words)
            length = np.diff(bounds)
            digest = [whole_text.hash(bounds[:-1], length, seed).astype(np.int64) for seed in (11, 12)]
            flat = pa.array(keys.astype(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array(n), lists], names=["id", "d1", "d2", "n", "bands"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    return chosen.mapInArrow(run, "id long, d1 long, d2 long, n long, bands array<long>")


def odd_sketches(found: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and two sketches of ODD bits of each of n sets.

    A bit tells whether an odd number of the elements fall on it, so two sketches differ in at most
    as many bits as the sets differ in elements.  At level l an element is taken with a chance of
    4**-l; a set is sketched at the first level that leaves about ODD elements, and at the next one.
    """
    size = np.bincount(owner, minlength=n)
    level = np.ceil(np.log2(np.maximum(size / ODD, 1.0)) / 2.0).astype(np.int64)
    draw, place = mix(found, 7), (mix(found, 8) % U(ODD)).astype(np.int64)
    out = np.zeros((n, 2 * ODD // 64), np.int64)
    cuts = np.searchsorted(owner, np.arange(0, n + 1024, 1024))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows = owner[a:b] - 1024 * i
        here = min(1024, n - 1024 * i)
        for j in (0, 1):
            mask = (U(1) << (U(2) * (level[owner[a:b]] + j).astype(U))) - U(1)
            taken = (draw[a:b] & mask) == 0
            odd = np.bincount(rows[taken] * ODD + place[a:b][taken], minlength=here * ODD) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(here, ODD), axis=1, bitorder="little")
            out[1024 * i : 1024 * i + here, j * ODD // 64 : (j + 1) * ODD // 64] = bits.view("<i8")
    return level, out


def shingle_sets(docs: DataFrame, *, width: int) -> DataFrame:
    """``id, set`` (sorted 64-bit hashes as bytes), ``level, sketch`` (odd sketches) of rows ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 0, 1):
            found, _, owner = shingles(texts, width)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            sets = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            level, odd = odd_sketches(found, owner, len(texts))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, odd.size + 1, odd.shape[1], dtype=np.int32)), pa.array(odd.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.large_binary()).cast(pa.binary()), pa.array(level.astype(np.int32)), sketch], names=["id", "set", "level", "sketch"])

    return docs.mapInArrow(run, "id long, set binary, level int, sketch array<long>")


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b, left, right`` (sets) whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 4,
    weighted: bool = False,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``id, class_id, group_id, n_links``.

    ``class_id``: least id among texts of the same words; ``group_id``: least id among classes
    linked over any path; ``n_links``: verified links of the class.  A pair of similarity 0.8 shares
    no band with probability (1 - 0.8**rows)**bands, 3e-6 by default.
    """
    spark = docs.sparkSession
    work = scratch(spark, "near-dedup")
    # tables after the first are sized by rows counted before: many are small, and each is a job of its own
    written = work.save(sign(docs, width=width, bands=bands, rows=rows, weighted=weighted, id_col=id_col, text=text), "signed")
    signed = written.frame
    classes = signed.groupBy("d1", "d2").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    written = work.save(classes.where("class IS NOT NULL"), "classes", about=written.rows)
    classes, n_classes = written.frame, written.rows
    members = classes.where("n > 0").select("class", "n", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    written = work.save(members.join(sizes, ["band", "key"]), "members", about=bands * n_classes)
    members, n_members = written.frame, written.rows
    # first each class against one hub only, the least it meets
    first = members.where("class <> hub").groupBy("class").agg(F.min("hub").alias("hub"))
    written = work.save(first.select(F.col("hub").alias("a"), F.col("class").alias("b")), "pairs", about=n_members)
    tested, n_tested = written.frame, written.rows
    written = work.save(members.select("class").distinct(), "in_play", about=n_members)
    in_play, n_in_play = written.frame, written.rows
    sets = _sets_of(docs, in_play, width=width, id_col=id_col, text=text)
    sets = saved(work, sets, "sets", SET_ROWS * n_in_play)
    written = work.save(verified(tested, sets, threshold), "links", about=SET_ROWS * n_tested)
    links, n_links = written.frame, written.rows
    labels = saved(work, _components(links, in_play, n_links), "labels", n_in_play)
    for step in ("first", "some", "all"):  # whatever could still join two components
        # the sketches looked at follow the members
        written = work.save(_untested(members, labels, sets, threshold, step).join(tested, ["a", "b"], "left_anti"), "pairs-" + step, about=n_members + n_tested)
        if not written.rows:
            continue
        more = written.frame
        tested, n_tested = tested.unionByName(more), n_tested + written.rows
        written = work.save(verified(more, sets, threshold), "links", about=SET_ROWS * written.rows)
        if written.rows:
            links, n_links = links.unionByName(written.frame), n_links + written.rows
            labels = saved(work, _components(links, in_play, n_links), "labels", n_in_play)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    groups = classes.select("class", "d1", "d2").join(labels, "class", "left").join(degree, "class", "left")
    groups = groups.select("d1", "d2", F.col("class").alias("class_id"), F.coalesce("group", "class").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    groups = saved(work, groups, "groups", n_classes + 2 * n_links)
    return signed.select("id", "d1", "d2").join(groups, ["d1", "d2"], "left").select("id", "class_id", "group_id", "n_links")


def _sets_of(docs: DataFrame, wanted: DataFrame, *, width: int, id_col: str, text: str) -> DataFrame:
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    chosen = chosen.join(wanted.withColumnRenamed("class", "id"), "id", "left_semi")
    return shingle_sets(chosen, width=width).dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("right"))
    return _similar(pairs.join(left, "a").join(right, "b"), threshold)


def _components(links: DataFrame, vertices: DataFrame, rows: int) -> DataFrame:
    found = connected_components(links, src="a", dst="b", vertices=vertices.withColumnRenamed("class", "id"), rows=rows)
    return found.select(F.col("id").alias("class"), F.col("component").alias("group"))


def may_be_similar(threshold: float) -> Column:
    """Whether rows ``nx, lx, sx`` and ``n, level, sketch`` (shingles, odd sketches) can reach the threshold.

    Sets of that similarity differ in at most (1 - t) / (1 + t) of their sizes' sum.  At level 0 the
    bound is exact; at the others it is passed by chance with less than 1e-6 (Poisson tail).
    """
    level = F.greatest("lx", "level")
    differ = F.lit(0)
    for i in range(ODD // 64):
        x = F.get("sx", (level - F.col("lx")) * (ODD // 64) + i)
        y = F.get("sketch", (level - F.col("level")) * (ODD // 64) + i)
        differ = differ + F.bit_count(x.bitwiseXOR(y))
    most = (F.col("nx") + F.col("n")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    taken = most * F.pow(F.lit(4.0), -level)
    sizes = F.least("n", "nx") >= threshold * F.greatest("n", "nx")
    return sizes & (differ <= F.when(level == 0, most).otherwise(taken + 5 * F.sqrt(taken) + 6))


def _untested(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float, step: str) -> DataFrame:
    """Pairs that share a bucket but no component.

    ``first``: each member against its bucket's first member.  ``some``: each member outside the
    bucket's largest component against SAMPLE members of that one, other ones in each bucket.  ``all``:
    each such member against the members of all other components, from one side only.  Sizes and
    odd sketches that rule the similarity out are dropped inside the join.  A bucket whose members
    are linked gives no pair, so the pairs follow the members that stay apart and may be similar.
    """
    placed = members.join(labels, "class")
    if step == "first":
        hub = labels.select(F.col("class").alias("hub"), F.col("group").alias("hub_group"))
        return placed.join(hub, "hub").where("group <> hub_group").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    parts = placed.groupBy("band", "key", "group").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("band", "key").agg(F.max(F.struct("m", "group")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    placed = placed.join(main.select("band", "key", F.col("main.group").alias("main")), ["band", "key"])
    apart = placed.where("group <> main").select("band", "key", F.col("class").alias("x"), F.col("group").alias("gx"), F.col("n").alias("nx"))
    if step == "some":
        draw = F.struct(F.xxhash64("class", "band"), "class", "group", "n")
        kept = [F.min(F.when(F.pmod(F.xxhash64("class", "key"), F.lit(SAMPLE)) == i, draw)).alias(f"s{i}") for i in range(SAMPLE)]
        drawn = placed.where("group = main").groupBy("band", "key").agg(*kept)
        placed = drawn.select("band", "key", F.explode(F.array(*[f"s{i}" for i in range(SAMPLE)])).alias("s")).where("s IS NOT NULL").select("band", "key", "s.class", "s.group", "s.n")
    apart = apart.join(sets.select(F.col("id").alias("x"), F.col("level").alias("lx"), F.col("sketch").alias("sx")), "x")
    placed = placed.join(sets.select(F.col("id").alias("class"), "level", "sketch"), "class")
    fits = (F.col("gx") != F.col("group")) & may_be_similar(threshold)
    if step == "all":  # of two members outside, the lesser id looks for the greater
        fits = ((F.col("group") == F.col("main")) | (F.col("x") < F.col("class"))) & fits
    pairs = apart.join(placed, ["band", "key"]).where(fits)
    return pairs.select(F.least("x", "class").alias("a"), F.greatest("x", "class").alias("b")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
