"""Best-fit packing by sums of squares.

Documents become token pieces; a piece goes where the sum over residual gaps of (open bins with that
gap) squared becomes least, and a new bin is opened only if no open one fits.  Long pieces go first.

The rule needs nothing but sizes.  So the corpus is counted by size (at most ``capacity`` rows,
whatever the input), the rule is run on these counts, and its result, which says for runs of
documents of one size in which run of bins they lie, is applied by all tasks in parallel.  Documents
of a size are placed in portions of 1/PORTIONS of their number, one by one if there are few; so the
work and the table that is sent to the tasks are bounded by capacity x PORTIONS.

Defined cases: NULL text is empty and gives the end token alone; only documents longer than the
capacity are cut, their first piece being the shorter one; repeated rows are packed each; an empty
table gives an empty frame; columns other than id and text are not read.
"""

from __future__ import annotations

import array
import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from islets.llm.shared import read, saved, scratch, whole

CAPACITY = 1024
END = 2
#: The added token of the tokenizer file.
ADDED, ADDED_ID = "<|endoftext|>", 50256
PORTIONS = 64
#: Ids of pieces of text that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: The characters that the tokenizer's pattern takes as white space.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0                　"

_tokenizers: dict = {}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, remembered by word.

    The vocabulary's rank file gives the same ids as its tokenizer file, several times as fast; the
    tests compare the two.  The pattern that cuts a text first takes white space only as the lead of
    what follows, so a text can be cut before a blank that follows a visible character, and the parts
    encoded alone.  Strings of special tokens in a text are their ids, as the tokenizer file has it.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array.array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if ADDED in text:
            return array.array("I", [ADDED_ID]).tobytes().join(map(self.encode, text.split(ADDED)))
        blanks = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" if text.isascii() else BLANKS
        if any(blank + " " in text for blank in blanks):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for part in set(rest).difference(known):
            known[part] = self._ids(" " + part)
        return (self._ids(first) if first else b"") + b"".join(map(known.__getitem__, rest))


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, tokens, crcs`` (of each piece) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tokens, crcs = [], []
                for body in part.column(1).to_pylist():
                    ids = encode(body) + end
                    n = len(ids) // 4
                    head = n % capacity or capacity
                    cuts = [0, *range(head, n + 1, capacity)]
                    tokens.append(n)
                    crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["id", "tokens", "crcs"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    return chosen.mapInArrow(run, "id long, tokens long, crcs array<long>")


def pack_sizes(counts: dict[int, int], capacity: int = CAPACITY, portions: int = PORTIONS) -> tuple[np.ndarray, int]:
    """The rule on counts of sizes below the capacity.

    Gives rows (size, from, to, bin, offset): documents ``from`` to ``to`` (exclusive) of a size lie in
    the bins from ``bin`` on, one each, at ``offset``; and the number of bins.
    """
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap: runs (first bin, how many)
    n = np.zeros(capacity + 1)
    placed, bins = [], 0
    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        portion = max(1, left // portions)
        while left:
            take = min(portion, left)
            gaps = np.arange(size, capacity + 1)
            gaps = gaps[n[gaps] > 0]
            if len(gaps):
                # change of the sum of squares: one bin less with this gap, one more with what remains
                change = 1 - 2 * n[gaps] + np.where(gaps > size, 2 * n[gaps - size] + 1, 0)
                gap = int(gaps[np.argmin(change)])
                first, many = open_bins[gap].pop()
                used = min(many, take)
                if many > used:
                    open_bins[gap].append((first + used, many - used))
            else:
                gap, first, used = capacity, bins, take
                bins += used
            n[gap] -= used if gap < capacity else 0
            placed.append((size, at, at + used, first, capacity - gap))
            if gap > size:
                open_bins[gap - size].append((first, used))
                n[gap - size] += used
            at += used
            left -= used
    return np.array(placed, np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    work = scratch(spark, "packing")
    # written with the part and place of each row, so that both stay as they are
    rows = tokenized(docs, tokenizer, capacity=capacity, id_col=id_col, text=text)
    rows = saved(work, rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "tokens")
    rows = rows.withColumn("head", (F.col("tokens") % capacity).cast("int")).withColumn("full", F.floor(F.col("tokens") / capacity))
    # the place of a row among those of its head's size: by part, then within the part
    by_part = rows.groupBy("head", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full_n"))
    before = Window.partitionBy("head").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    by_part = saved(work, by_part, "counts")
    counts = {r["head"]: r["n"] for r in by_part.where("head > 0").groupBy("head").agg(F.sum("n").alias("n")).collect()}  # < capacity rows
    layout, bins = pack_sizes(counts, capacity)
    plan = spark.sparkContext.broadcast(layout)  # bounded by capacity x PORTIONS
    inside = Window.partitionBy("part", "head").orderBy("pos")
    numbered = rows.withColumn("row", F.row_number().over(inside) - 1)
    numbered = numbered.join(by_part.select("head", "part", "base"), ["head", "part"]).withColumn("nth", F.col("base") + F.col("row"))
    # whole bins are numbered by part, after the shared ones
    parts = by_part.groupBy("part").agg(F.sum("full_n").alias("n"))
    parts = saved(work, parts, "parts")
    spans = parts.select("part", (F.lit(bins) + F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("first_full"))
    in_part = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("full_before", F.coalesce(F.sum("full").over(in_part), F.lit(0))).join(spans, "part")
    numbered = numbered.withColumn("full_id", F.col("first_full") + F.col("full_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        base = int(table[:, 2].max()) + 1 if len(table) else 1
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            head = batch.column("head").to_numpy().astype(np.int64)
            nth = batch.column("nth").to_numpy()
            at = np.maximum(np.searchsorted(keys, head * base + nth, side="right") - 1, 0)
            found = table[at] if len(table) else np.zeros((len(head), 5), np.int64)
            bin_ = np.where(head > 0, found[:, 3] + nth - found[:, 1], -1)
            offset = np.where(head > 0, found[:, 4], 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "crcs", "head", "full_id")), pa.array(bin_), pa.array(offset)],
                names=["id", "crcs", "head", "full_id", "bin", "offset"],
            )

    placed = numbered.select("id", "crcs", "head", "full_id", "nth").mapInArrow(
        place, "id long, crcs array<long>, head int, full_id long, bin long, offset long"
    )
    cut = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    first = (F.col("head") > 0) & (F.col("piece") == 0)
    whole_before = F.col("piece") - F.when(F.col("head") > 0, 1).otherwise(0)
    return cut.select(
        "id",
        F.col("piece").cast("int").alias("piece"),
        F.when(first, 0).otherwise(F.col("head") + whole_before * capacity).cast("long").alias("start"),
        F.when(first, F.col("head")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        F.when(first, F.col("bin")).otherwise(F.col("full_id") + whole_before).cast("long").alias("sequence_id"),
        F.when(first, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")
