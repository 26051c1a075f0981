"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against the blocks of all documents with a smaller id.

* Reference blocks are chosen by content: of each run of ``window`` words, the block of ``BLOCK``
  words with the least hash (the first of equal ones).  Equal runs choose equal blocks, so every
  repeat of a whole run meets in the index, and about one word in twenty starts a block.
* A factor is a maximal stretch of runs that share one block occurrence.  It is hashed as a whole; a
  factor that stands in an earlier document is taken as one piece, and copies are settled here, one
  row per factor.
* Factors that are first of their kind, but whose block has others, reach a factor boundary: there
  the runs are checked one by one against those of the other first factors of the block.

Words covered by a run that also starts in a document with a smaller id are removed.  Equality is
that of 64-bit hashes of the block and of what surrounds it; words are hashed eight bytes after eight.

Defined cases: NULL text has no words; texts shorter than the window stay; of repeats inside one
document or among rows of one id nothing is removed, since none has a smaller id; rows with a NULL
id are kept whole and are no reference; rows that repeat an id are treated alike; an empty table
gives an empty frame; no other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm.hashing import Windows, chunks, leftmost_min, word_hashes
from islets.llm.shared import read, saved, scratch, whole

BLOCK = 10


def factors(texts: list[bytes], window: int, block: int = BLOCK):
    """Maximal stretches of runs with one block: text, block hash, factor hash, start, runs.

    Starts are counted in words from the start of the text; also the hashes of the words.
    """
    words, bounds = word_hashes(texts, lanes=True)
    prefix = Windows(words)
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < window:
        return prefix, bounds, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    heads = np.arange(n - block + 1)
    blocks = prefix.hash(heads, np.full(len(heads), block), 1)
    chosen = leftmost_min(blocks, window - block + 1)  # one for each run of the window's length
    owner = np.searchsorted(bounds, np.arange(len(chosen)), side="right") - 1
    inside = np.arange(len(chosen)) + window <= bounds[owner + 1]
    runs = np.flatnonzero(inside)
    if not len(runs):
        return prefix, bounds, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    new = np.ones(len(runs), bool)
    new[1:] = (chosen[runs][1:] != chosen[runs][:-1]) | (runs[1:] != runs[:-1] + 1) | (owner[runs][1:] != owner[runs][:-1])
    at = np.flatnonzero(new)
    start, many = runs[at], np.diff(np.append(at, len(runs)))
    factor = prefix.hash(start, many + (window - 1), 2)
    return prefix, bounds, owner[start], blocks[chosen[start]], factor, start, many


def parse(docs: DataFrame, window: int) -> DataFrame:
    """``id, block, factor, start, runs`` of rows ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 0, 1, 1 << 20):
            _, bounds, owner, blocks, factor, start, many = factors(texts, window)
            keys = pa.array(ids, pa.int64()).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(blocks.astype(np.int64)), pa.array(factor.astype(np.int64)), pa.array((start - bounds[owner]).astype(np.int32)), pa.array(many.astype(np.int32))],
                names=["id", "block", "factor", "start", "runs"],
            )

    return docs.where("id IS NOT NULL").mapInArrow(run, "id long, block long, factor long, start int, runs int")


def _runs_of(docs: DataFrame, window: int) -> DataFrame:
    """Each run of the stretches ``spans`` (block, start, runs) of rows ``id, text, spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, _ = word_hashes([(batch.column(1)[i].as_py() or "").encode()], lanes=True)
                spans = batch.column(2)[i].values
                block, start, many = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "start", "runs"))
                at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                fits = at + window <= len(words)  # rows that repeat an id may hold other texts
                at, block = at[fits], np.repeat(block, many)[fits]
                found = Windows(words).hash(at, np.full(len(at), window), 3).astype(np.int64)
                ids = pa.array(np.full(len(at), batch.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(block), pa.array(found), pa.array(at.astype(np.int32))], names=["id", "block", "run", "start"])

    return docs.select("id", "text", "spans").mapInArrow(run, "id long, block long, run long, start int")


def duplicate_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """``id, spans``: for each document with repeats, (start, words) to remove; rows ``id, text``."""
    work = scratch(docs.sparkSession, "substring-dedup")
    parsed = saved(work, parse(docs, window), "factors")
    kinds = parsed.groupBy("block", "factor").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = saved(work, kinds, "kinds")
    # whole factors that an earlier document has
    again = parsed.join(kinds.where("n > 1"), ["block", "factor"]).where("id > first")
    spans = again.select("id", "start", F.col("runs"))
    # factor boundaries: first factors of blocks that have several
    several = kinds.groupBy("block").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("block")
    firsts = kinds.join(several, "block", "left_semi").select("block", "factor", F.col("first").alias("id"))
    firsts = parsed.join(firsts, ["block", "factor", "id"], "left_semi")
    by_doc = firsts.groupBy("id").agg(F.collect_list(F.struct("block", "start", "runs")).alias("spans"))
    by_doc = saved(work, by_doc, "boundaries")
    runs = saved(work, _runs_of(docs.join(by_doc, "id"), window), "runs")
    first_run = runs.groupBy("block", "run").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = runs.join(first_run, ["block", "run"]).where("id > first").select("id", "start", F.lit(1).alias("runs"))
    spans = spans.unionByName(late)
    found = spans.groupBy("id").agg(F.collect_list(F.struct("start", (F.col("runs") + (window - 1)).alias("words"))).alias("spans"))
    return saved(work, found, "spans")


def substring_dedup(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept_text`` of each row; ``kept_text``: the words left, one blank between."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    spans = duplicate_spans(rows, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                total, removed, kept = [], [], []
                for text_, spans_ in zip(part.column(1).to_pylist(), part.column(2)):
                    words = text_.encode().split()  # bytes: splits at exactly [\x20\x09-\x0D]
                    total.append(len(words))
                    if spans_.is_valid and len(spans_.values):
                        edges = np.zeros(len(words) + 1, np.int64)
                        begin = spans_.values.field("start").to_numpy(zero_copy_only=False)
                        length = spans_.values.field("words").to_numpy(zero_copy_only=False)
                        np.add.at(edges, np.minimum(begin, len(words)), 1)
                        np.add.at(edges, np.minimum(begin + length, len(words)), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return rows.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The rule itself, window by window.
SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents)
),
runs AS (
  SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS run FROM w
),
hashed AS (SELECT doc_id, i, md5(array_to_string(run, ' ')) AS h FROM runs WHERE len(run) = 50),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM hashed) WHERE first < doc_id),
covered AS (
  SELECT w.doc_id, w.i, w.w, max(late.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN late ON late.doc_id = w.doc_id AND late.i = w.i
)
SELECT d.doc_id, CAST(count(w) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered USING (doc_id) GROUP BY d.doc_id
"""
