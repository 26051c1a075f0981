"""Quality classifier: regularised quadratic discriminant analysis.

Documents become statistics of their text (lengths, shares of kinds of characters and words, repeats),
transformed so that they are near to normal.  Each class gets a mean and a covariance, shrunk towards
the pooled one and towards its diagonal; the score is the logistic value of the difference of the two
log densities, from Mahalanobis distances by Cholesky factors that are computed once.

Learning needs sums only: moments per class are added up by Spark, so all labelled rows take part and
the model (a few hundred numbers) is what reaches the driver.

Defined cases: NULL text counts as empty, and an empty text gets a score like any other; labels that
are NULL, of unknown documents or contradict each other are left out of learning; repeated label rows
count once; with one class only, or none, every score is the share of label 1 (0.5 without labels);
rows with a NULL id are scored and not held out; an empty table gives an empty frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm.shared import read, saved, scratch, whole

FEATURES = (
    "words", "word_length", "word_spread", "distinct", "upper", "digits", "symbols", "stops", "exclaims", "lines",
    "line_words", "repeated_lines", "repeated_pairs", "first_share", "short_words", "capital_words", "ended_lines", "letters", "long_words", "commas",
)
#: Shrinkage of class covariances: towards the pooled one, towards the diagonal.
POOLED, DIAGONAL = 0.2, 0.05
#: Log density differences are divided by this, since statistics of a text are not independent.
TEMPERATURE = 3.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of FEATURES."""
    words = text.split()
    n = len(words)
    chars = len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lengths = np.fromiter(map(len, words), float, n)
    joined = "".join(words)
    visible = len(joined)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    pairs = set(zip(words, words[1:]))
    share = lambda part, all_: np.arcsin(np.sqrt(min(1.0, part / max(all_, 1))))
    letters = len(_NOT_LETTERS.sub("", joined))
    upper = sum(1 for c in joined if c.isupper())
    return [
        np.log1p(n),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        share(len(counts), n),
        share(upper, visible),
        share(len(_DIGITS.findall(joined)), visible),
        share(len(_SYMBOLS.findall(joined)), visible),
        share(text.count(". ") + text.count(".\n"), n),
        share(text.count("!") + text.count("?"), n),
        np.log1p(len(lines)),
        np.log1p(n / max(len(lines), 1)),
        share(len(lines) - len(set(lines)), len(lines)),
        share(n - 1 - len(pairs), n),
        share(max(counts.values()), n),
        share(int((lengths <= 2).sum()), n),
        share(sum(map(str.istitle, words)), n),
        share(sum(line.rstrip()[-1] in ".!?" for line in lines), len(lines)),
        share(letters, visible),
        share(int((lengths >= 12).sum()), n),
        share(text.count(","), n),
    ]


_NOT_LETTERS = re.compile(r"[\W\d_]+")
_DIGITS = re.compile(r"\d")
_SYMBOLS = re.compile(r"[#*$%&|<>@~^=+{}\[\]\\/_]")


def features(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, x`` (the statistics) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [[float(v) for v in statistics(body)] for body in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text")).mapInArrow(run, "id long, x array<double>")


def held_out(id_col: Column) -> Column:
    """Whether labels of the row are kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``id, y``: the labels to learn from, one row per document."""
    clean = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = clean.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("most"))
    return one.where("y = most").select("id", F.col("y").cast("int").alias("y"))


def moments(examples: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of ``x`` for each ``y``; summed in the tasks, then by Spark."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.array(batch.column(1).flatten()).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for label in np.unique(y):
                own = x[y == label]
                sums[int(label)] = sums.get(int(label), 0) + own.T @ own
        y = [label for label in sums for _ in range((d + 1) ** 2)]
        at = list(range((d + 1) ** 2)) * len(sums)
        value = np.concatenate([s.ravel() for s in sums.values()]) if sums else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(value)], names=["y", "at", "value"])

    added = examples.select("y", "x").mapInArrow(run, "y int, at int, value double").groupBy("y", "at").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for row in added.collect():  # (features + 1) ** 2 numbers for each class
        found.setdefault(row["y"], np.zeros((d + 1) ** 2))[row["at"]] = row["value"]
    out = {}
    for label, flat in found.items():
        s = flat.reshape(d + 1, d + 1)
        out[label] = (int(s[0, 0]), s[0, 1:], s[1:, 1:])
    return out


class Discriminant:
    """Log density difference of two normal classes."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        n0, n1 = (sums[y][0] if y in sums else 0 for y in (0, 1))
        self.share = (n1 / (n0 + n1)) if n0 + n1 else 0.5
        self.parts = []
        if not n0 or not n1:
            return
        scatter = {y: sums[y][2] - np.outer(sums[y][1], sums[y][1]) / sums[y][0] for y in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n0 + n1)
        scale = np.maximum(np.diag(pooled), 1e-6)
        for y in (0, 1):
            n = sums[y][0]
            alpha = max(POOLED, 10.0 / (n + 10.0))
            cov = (1 - alpha) * scatter[y] / n + alpha * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(scale)
            factor = np.linalg.cholesky(cov)
            inverse = np.linalg.inv(factor)  # cached: a distance is one product
            self.parts.append((sums[y][1] / n, inverse, 2.0 * np.log(np.diag(factor)).sum(), np.log(n / (n0 + n1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        logs = [prior - 0.5 * (np.square((x - mean) @ inverse.T).sum(axis=1) + logdet) for mean, inverse, logdet, prior in self.parts]
        z = np.clip((logs[1] - logs[0]) / TEMPERATURE, -50, 50)
        return 1.0 / (1.0 + np.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, label: str, *, threshold: float = 0.7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of each row; ``labels`` has ``id_col`` and ``label`` (0 or 1)."""
    spark = docs.sparkSession
    work = scratch(spark, "quality")
    rows = saved(work, features(docs, id_col=id_col, text=text), "features")
    # repeated rows of a document count once; of different texts of one id, the least
    known = rows.join(learnable(labels, label, id_col), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    model = Discriminant(moments(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality")
    return found.withColumnRenamed("id", "doc_id")
