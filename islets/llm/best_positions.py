"""Ranked lexical search: best position algorithm over impact lists.

Each block of documents holds one impact list per query term: its documents by falling score of the
term.  For an item, the first unseen position of each list is read (a direct access), and each document
met is looked up in the item's other lists, which gives its whole score and marks its position in every
list.  The best position of a list is the last one before its first unseen position: every document not
seen yet stands behind it in each list, so the scores at the best positions add up to a bound on what it
can reach.  Positions count however they were seen, so this bound falls faster than one over the
positions read in order.  The search of a block ends once the bound is strictly below the k-th score,
so equal scores never lose a document.  The k best of a task's blocks are carried on, so later blocks
start with a high k-th score; the k best of all tasks are merged.

Items are searched in blocks of about ``BLOCK_TERMS`` terms, each against all documents; a block of items
is all that is sent to the tasks.  All numbers but the weights of terms are 64-bit integers.

Defined cases: NULL and empty texts have no terms, so such documents count nowhere and such items get
no rows; rows of one item id are one item with all their terms; a NULL item id is an item like others;
each row of documents is one document, also if it repeats another; NULL document ids come after all
others among equal scores; items and documents without a common term, and empty tables, give no rows;
further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from islets.llm.hashing import chunks
from islets.llm.shared import read, saved, scratch

K = 10
#: Rows (item, term) that are searched, and sent to each task, at a time.
BLOCK_TERMS = 200_000
#: Postings of a block of documents.
BLOCK_POSTINGS = 1 << 20
#: Direct accesses to each list in the first step; the number doubles up to the second.
ACCESSES, MOST_ACCESSES = 16, 2048
#: Letters and digits of ASCII and every byte of other characters make up terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats; only A-Z are lower-cased."""
    return text.translate(_TERMS).split()


def item_terms(items: DataFrame, *, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term`` (UTF-8 bytes): the different terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, 0, 1):
            rows = [(key, term) for key, raw in zip(ids, texts) for term in set(terms_of(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], names=["item", "term"])

    chosen = items.select(F.col(item_col).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "item long, term binary").distinct()


def postings(docs: DataFrame, terms, *, id_col: str, text: str) -> DataFrame:
    """``id, n, terms, tf`` of each row that has a term: length, the numbers of the wanted terms and their counts.

    ``terms`` is a broadcast dictionary from terms to numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for ids, texts in chunks(batches, 0, 1):
            keys, lengths, cuts, numbers, counts = [], [], [0], [], []
            for key, raw in zip(ids, texts):
                found = terms_of(raw)
                if not found:
                    continue
                tf = Counter(found)
                here = tf.keys() & known.keys()
                keys.append(key)
                lengths.append(len(found))
                numbers += [known[x] for x in here]
                counts += [tf[x] for x in here]
                cuts.append(len(numbers))
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (numbers, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "tf"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


class Best:
    """The k best documents so far: scores, whether the id is NULL, ids."""

    def __init__(self, k: int):
        self.k = k
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, bool, np.int64))

    def kth(self) -> int:
        return int(self.rows[0][self.k - 1]) if len(self.rows[0]) >= self.k else 0

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.kth())
        if some.any():
            rows = [np.concatenate(x) for x in zip(self.rows, (scores[some], null[some], ids[some]))]
            order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
            self.rows = tuple(x[order] for x in rows)


class ImpactLists:
    """The impact lists of a block of documents, for direct and for random access."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray):
        some = score > 0
        term, doc, score = term[some], doc[some], score[some]
        order = np.lexsort((doc, -score, term))
        self.doc, self.score, term = doc[order], score[order], term[order]
        self.terms, starts = np.unique(term, return_index=True)
        self.bounds = np.append(starts, len(term))
        # the same postings by document: where each stands in its impact list
        self.by_doc = np.lexsort((self.doc, term))
        self.sorted_docs = self.doc[self.by_doc]
        self.place = self.by_doc - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def lists(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Documents and scores by position, documents in order and their positions, of each wanted term."""
        at = np.flatnonzero(np.isin(self.terms, wanted, assume_unique=True))
        cuts = [slice(self.bounds[i], self.bounds[i + 1]) for i in at]
        return [(self.doc[c], self.score[c], self.sorted_docs[c], self.place[c]) for c in cuts]

    def search(self, wanted: np.ndarray, best: Best, null: np.ndarray, ids: np.ndarray) -> int:
        """Add the block's best documents for some terms; gives the number of documents that were looked at."""
        lists = self.lists(wanted)
        seen = [np.zeros(len(x[0]), bool) for x in lists]
        position = [0] * len(lists)  # how many places from the first on are seen
        looked, step = 0, ACCESSES
        while True:
            bound = sum(int(x[1][p - 1]) if p else int(x[1][0]) for x, p in zip(lists, position) if p < len(x[0]))
            if bound <= 0 or best.kth() > bound:
                break
            ahead = []
            for x, p, s in zip(lists, position, seen):
                ahead.append(x[0][p : p + step][~s[p : p + step]])
            new = np.unique(np.concatenate(ahead))
            total = np.zeros(len(new), np.int64)
            for i, (_, score, docs, place) in enumerate(lists):
                at = np.searchsorted(docs, new)
                at[at == len(docs)] = 0
                hit = docs[at] == new
                where = place[at[hit]]
                total[hit] += score[where]
                seen[i][where] = True
                rest = seen[i][position[i] :]
                if len(rest):
                    gap = int(rest.argmin())
                    position[i] += len(rest) if rest[gap] else gap
            best.add(total, null[new], ids[new])
            looked += len(new)
            step = min(2 * step, MOST_ACCESSES)
        return looked


def impact(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Scores of postings: count in the document, the document's length, weight of the term; corpus counts."""
    m = 10 + (90 * n * n_docs) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _search(index: DataFrame, wanted, *, n_docs: int, length: int, k: int) -> DataFrame:
    """``item`` (number), ``doc_id, score`` of the k best documents of each task; ``wanted`` is (items, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = wanted.value
        best = [Best(k) for _ in items]
        block: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(block).combine_chunks()
            block.clear()
            ids = rows["id"]
            null, ids = ids.is_null().to_numpy().astype(bool), ids.fill_null(0).to_numpy()
            lists = [rows[c].chunk(0) for c in ("terms", "tf")]
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            doc = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
            score = impact(tf, rows["n"].to_numpy().astype(np.int64)[doc], weight[term], n_docs, length)
            index = ImpactLists(term, doc, score)
            for terms, found in zip(items, best):
                index.search(terms, found, null, ids)

        held = 0
        for batch in batches:
            if batch.num_rows:
                block.append(batch)
                held += len(batch.column(2).flatten())
            if held >= BLOCK_POSTINGS:
                search()
                held = 0
        if block:
            search()
        for number, found in enumerate(best):
            score, null, ids = found.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids, pa.int64(), mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``item, rank, doc_id, score``: the k best of all tasks, first by salted parts of an item, then by item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number()
    parts = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    parts = parts.withColumn("rank", rank.over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return parts.withColumn("rank", rank.over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, *, k: int = K, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The k best documents of each item: ``item_id, rank, doc_id, score``, best first, equal scores by id."""
    spark = docs.sparkSession
    work = scratch(spark, "best-positions")
    wanted = work.save(item_terms(items, item_col=item_col, text=item_text), "terms")
    blocks = max(1, -(-wanted.rows // block_terms))
    parts = []
    for block in range(blocks):
        rows = wanted.frame.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        known = {term: i for i, term in enumerate(sorted({bytes(r.term) for r in rows}))}
        of_item: dict[int | None, list[int]] = {}
        for r in rows:
            of_item.setdefault(r.item, []).append(known[bytes(r.term)])
        numbered = list(of_item)
        index = work.save(postings(docs, spark.sparkContext.broadcast(known), id_col=id_col, text=text), "postings", length=F.sum("n"))
        if not (numbered and index.rows):
            continue
        df = np.zeros(len(known), np.int64)
        for r in index.frame.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r.term] = r["count"]
        sent = spark.sparkContext.broadcast(([np.array(sorted(x)) for x in of_item.values()], weights(df, index.rows)))
        found = _search(index.frame, sent, n_docs=index.rows, length=index.counts["length"], k=k)
        names = spark.createDataFrame(list(enumerate(numbered)), "item long, item_id long")
        best = _merged(saved(work, found, "found"), k).join(F.broadcast(names), "item")
        parts.append(best.select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Every score in full, then the ten best of each item.
SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
d AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c
),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
s AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (row), c GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
