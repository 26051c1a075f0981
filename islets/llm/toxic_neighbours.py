"""Toxicity: nearest labelled examples by exact TF-IDF cosine.

Texts become TF-IDF vectors over the terms that tell toxic examples from others.  The terms are words
and their leading characters (so that unseen endings still match), chosen by the log likelihood ratio
of the labels; in long texts all other words only add length.  The labelled examples form an inverted
index in blocks: for each term and block the greatest weight is kept, which bounds the cosine of every
example of the block.  Blocks are taken by falling bound until the bound falls below the k-th best, so
the k nearest are exact and no posting of a later block is read.  Votes are weighted by cosine, with a
prior of the examples without terms, and the neighbours' ids are the evidence.

The labelled sample is drawn first and is bounded (MAX_EXAMPLES, by least hash); terms, weights and
examples all come from it.  So what is collected and sent to the tasks is bounded by the sample, and no
text of the table is shuffled: the sample's ids are broadcast to the scan.

Defined cases: NULL text counts as empty; texts without a chosen term get the prior; contradicting or
NULL labels are left out, repeated label rows count once; of several texts of one labelled id, the one
of least term digest counts; without labels every score is 0; ties are broken by the lesser example id;
an empty table gives an empty frame; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm.quadratic_discriminant import held_out, learnable
from islets.llm.shared import read, saved, scratch, whole

#: Labelled rows that are learned from: of more, those with the least hash of their id.
MAX_EXAMPLES = 20_000
#: Least log likelihood ratio of a term: chance passes it once in 10,000 times (one degree of freedom).
LEAST_RATIO = 15.1
#: How many times as frequent a term is in examples of label 1; common words of long texts are not.
LEAST_LIFT = 3.0
LEAD = 5
NEIGHBOURS = 15
BLOCK = 64
PRIOR_WEIGHT = 0.5
_WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    """Words in lower case, and the leading characters of longer ones (marked by a star)."""
    counts = Counter(_WORDS.findall(text.lower()))
    leads: Counter = Counter()
    for word, n in counts.items():
        if len(word) > LEAD:
            leads[word[:LEAD] + "*"] += n
    counts.update(leads)
    return counts


def _term_counts(rows: DataFrame) -> DataFrame:
    """``id, y, copy, terms, counts`` of labelled rows ``id, y, text``; ``copy``: a digest of the whole set of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [sorted(terms(body).items()) for body in part.column(2).to_pylist()]
                names = [[t for t, _ in f] for f in found]
                copy = [blake2b("\n".join(n).encode(), digest_size=16).hexdigest() for n in names]
                counts = pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))
                columns = [part.column(0), part.column(1), pa.array(copy, pa.string()), pa.array(names, pa.list_(pa.string())), counts]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "copy", "terms", "counts"])

    found = rows.select("id", "y", "text").mapInArrow(run, "id long, y int, copy string, terms array<string>, counts array<long>")
    # a labelled id that several rows hold is one example
    one = found.groupBy("id", "y").agg(F.min(F.struct("copy", "terms", "counts")).alias("least"))
    return one.select("id", "y", "least.*")


def choose_terms(examples: DataFrame) -> DataFrame:
    """``term, idf`` of the terms that speak for label 1; rows ``id, y, copy, terms``.

    Texts of one label with the same set of terms are copies and count once, so that the words of a text
    with many copies do not look typical; every other text counts.
    """
    once = examples.groupBy("y", "copy").agg(F.min("id").alias("id"))
    kept = examples.join(once, ["y", "copy", "id"], "left_semi")
    n = kept.agg(F.sum(F.col("y").cast("double")).alias("n1"), F.count(F.lit(1)).cast("double").alias("n")).first()
    n1, total = n["n1"] or 0.0, n["n"] or 0.0
    n0 = total - n1
    if not n1 or not n0:
        return examples.select(F.lit("").alias("term"), F.lit(0.0).alias("idf")).limit(0)
    found = kept.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum(F.col("y").cast("double")).alias("a"), F.sum((1 - F.col("y")).cast("double")).alias("b")
    )
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    ratio = 2 * (
        part(a, (a + b) * n1 / total) + part(b, (a + b) * n0 / total)
        + part(n1 - a, (total - a - b) * n1 / total) + part(n0 - b, (total - a - b) * n0 / total)
    )
    chosen = found.where((a / n1 > LEAST_LIFT * b / n0) & (a > 1)).where(ratio >= LEAST_RATIO)
    return chosen.select("term", F.log((total + 1) / (a + b + 0.5)).alias("idf"))


class BlockMaxIndex:
    """Exact nearest examples by cosine, over unit vectors in blocks."""

    def __init__(self, idf: dict[str, float], examples: list[tuple[int, int, dict[str, int]]]):
        self.number = {term: i for i, term in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in sorted(idf)])
        rows = []
        for key, y, counts in sorted(examples, key=lambda e: e[0]):
            at, values = self.vector(counts)
            rows.append((key, y, at, values))
        spoken = [r for r in rows if len(r[2])]
        silent = [r for r in rows if not len(r[2])]
        self.prior = sum(r[1] for r in silent) / len(silent) if silent else (sum(r[1] for r in rows) / len(rows) if rows else 0.0)
        # like examples side by side make tight bounds
        spoken.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[0]))
        self.ids = np.array([r[0] for r in spoken], np.int64)
        self.labels = np.array([r[1] for r in spoken], float)
        blocks = -(-len(spoken) // BLOCK)
        postings: dict[int, tuple[list[int], list[float]]] = {}
        for place, (_, _, at, values) in enumerate(spoken):
            for t, v in zip(at, values):
                p = postings.setdefault(int(t), ([], []))
                p[0].append(place)
                p[1].append(float(v))
        self.postings, self.most = {}, {}
        for t, (places, values) in postings.items():
            places, values = np.array(places), np.array(values)
            most = np.zeros(blocks)
            np.maximum.at(most, places // BLOCK, values)
            self.postings[t] = (places, values, np.searchsorted(places, np.arange(blocks + 1) * BLOCK))
            self.most[t] = most
        self.blocks = blocks
        #: Blocks whose postings were read so far.
        self.opened = 0

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        pairs = sorted((self.number[t], n) for t, n in counts.items() if t in self.number)
        at = np.array([p[0] for p in pairs], np.int64)
        values = (1 + np.log(np.array([p[1] for p in pairs], float))) * self.idf[at] if pairs else np.zeros(0)
        length = np.sqrt(np.square(values).sum())
        return (at, values / length) if length > 0 else (at[:0], values[:0])

    def nearest(self, counts: dict[str, int], k: int = NEIGHBOURS) -> list[tuple[float, int, float]]:
        """Cosine, id and label of the k nearest examples with a cosine above 0."""
        at, values = self.vector(counts)
        known = [(t, v) for t, v in zip(at.tolist(), values.tolist()) if t in self.most]
        if not known:
            return []
        bound = sum(v * self.most[t] for t, v in known)
        order = np.argsort(-bound, kind="stable")
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        start, step = 0, 2
        while start < len(order):
            least = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
            batch = order[start : start + step]
            batch = batch[(bound[batch] > 0) & (bound[batch] >= least - 1e-9)]
            if not len(batch):
                break  # bounds fall, so every later block is below the k-th best as well
            more, found = self._exact(known, np.sort(batch))
            self.opened += len(batch)
            places, scores = np.concatenate([places, more]), np.concatenate([scores, found])
            start, step = start + step, 2 * step
        scores = np.round(scores, 12)
        best = np.lexsort((self.ids[places], -scores))[:k]
        return [(float(scores[i]), int(self.ids[places[i]]), float(self.labels[places[i]])) for i in best]

    def _exact(self, known: list[tuple[int, float]], blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the examples in some blocks that share a term with the text."""
        breaks = np.flatnonzero(np.diff(blocks) > 1) + 1
        places, scores = [], []
        for stretch in np.split(blocks, breaks):  # neighbouring blocks are read as one
            first, last = int(stretch[0]), int(stretch[-1]) + 1
            found = np.zeros((last - first) * BLOCK)
            for t, v in known:
                at, weights, cuts = self.postings[t]
                a, b = cuts[first], cuts[last]
                if a < b:
                    found[at[a:b] - first * BLOCK] += v * weights[a:b]
            hit = np.flatnonzero(found > 0)
            places.append(hit + first * BLOCK)
            scores.append(found[hit])
        return np.concatenate(places), np.concatenate(scores)

    def score(self, counts: dict[str, int]) -> tuple[float, list[int]]:
        """The share of label 1 among the neighbours, weighted by cosine, and the neighbours' ids."""
        near = self.nearest(counts)
        weight = sum(c for c, _, _ in near)
        votes = sum(c * y for c, _, y in near)
        return (votes + PRIOR_WEIGHT * self.prior) / (weight + PRIOR_WEIGHT), [key for _, key, _ in near]


def classify(docs: DataFrame, labels: DataFrame, label: str, *, threshold: float = 0.3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, score, predicted, neighbours`` of each row."""
    spark = docs.sparkSession
    work = scratch(spark, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    sample = learnable(labels, label, id_col).orderBy(F.xxhash64("id"), "id").limit(MAX_EXAMPLES)
    sample = saved(work, sample, "sample")
    examples = saved(work, _term_counts(rows.join(F.broadcast(sample), "id")), "examples")  # at most MAX_EXAMPLES
    chosen = saved(work, choose_terms(examples), "terms")  # terms of the sample only
    idf = {r["term"]: r["idf"] for r in chosen.collect()}
    counts: dict[int, dict[str, int]] = {}
    spread = examples.select("id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))))
    for r in spread.join(F.broadcast(chosen), "term").select("id", "term", "n").collect():
        counts.setdefault(r["id"], {})[r["term"]] = r["n"]
    index = BlockMaxIndex(idf, [(r["id"], r["y"], counts.get(r["id"], {})) for r in examples.select("id", "y").collect()])
    index = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = index.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scored = [model.score(terms(body)) for body in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array([e for _, e in scored], pa.list_(pa.int64()))], names=["id", "score", "neighbours"]
                )

    found = rows.mapInArrow(run, "id long, score double, neighbours array<long>")
    return found.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic")
    return found.withColumnRenamed("id", "doc_id")
