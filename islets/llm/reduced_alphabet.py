"""Spelling variant grouping: one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so that each symbol has about the same share of the letters of the
vocabulary.  An edit of a word is an edit of its reduced word, or none: words one edit apart have
reduced words that are equal or one edit apart.  So every different reduced word generates its one-edit
neighbourhood, which has few members as there are few symbols, the neighbourhoods are joined with the
reduced vocabulary, and what meets is verified on the original strings.  Of two reduced words one edit
apart, one has the other among its deletions or among its replacements by a greater symbol; only this
half of the full neighbourhood (itself, deletions, replacements, insertions) is generated, as the other
half gives the same pairs from their other ends.

Reduced words are 64-bit polynomials in their symbols, so a neighbour's key comes from prefix sums.  Two
reduced words with one key only mean that more strings are compared.

Counting: each run of letters is lower-cased (A-Z only); where 31 divides its checksum, one code point is
left out.  Runs are counted by task and then by word.  A word's form is its near word of largest count
(then the least in code-point order) if that one occurs ``ratio`` times as often at least; counts rise
tenfold from word to form, so a chain of forms is short, and pointers that double their reach find its end.

Defined cases: NULL and empty texts have no words; a NULL document id is the empty string in the checksum;
repeated rows count as often as they stand there; an empty table gives an empty frame; further columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm.hashing import U, mix
from islets.llm.shared import read, saved, scratch

LETTERS = r"[A-Za-zÀ-ÿ]+"
SYMBOLS = 8
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many runs loses a code point.
SPOILED = 31
#: Words a task holds before it hands on their counts.
HELD = 500_000
#: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, all else a blank.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _count(key, text: str, counts: Counter, least: int) -> None:
    """Add the words of a text of at least ``least`` code points; each letter is one byte of Latin-1."""
    runs = Counter(text.encode("latin-1", "replace").translate(_RUNS).split())
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in runs.items():
        if len(run) >= least:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % SPOILED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            counts[run] += n


def vocabulary(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of enough code points and occurrences over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            rows = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                for key, body in zip(batch.column(0).slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist()):
                    if body:
                        _count(key, body, counts, least_length)
                if len(counts) >= HELD:
                    yield counted()
        yield counted()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counts = chosen.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbols_of(words: DataFrame, symbols: int = SYMBOLS) -> dict[str, int]:
    """A symbol from 1 on for each letter; letters by falling frequency go to the symbol with the least share."""
    rows = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    share, found = [0] * symbols, {}
    for row in sorted(rows, key=lambda r: (-r["count"], r.letter)):
        least = share.index(min(share))
        share[least] += row["count"]
        found[row.letter] = least + 1
    return found


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, U), np.multiply.accumulate(np.full(n, b, U)))) for b in (_BASE, _INVERSE))


def _reduce(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some words, one after the other, and where each word starts (one more at the end)."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return table[flat], np.concatenate((np.zeros(1, np.int64), np.cumsum([len(w) for w in words], dtype=np.int64)))


def neighbourhoods(symbols: np.ndarray, bounds: np.ndarray, n_symbols: int, full: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of reduced words, and (word, key) of the different members of their one-edit neighbourhoods.

    Without ``full``: the word itself, its deletions, and replacements by greater symbols.
    """
    n = len(bounds) - 1
    word = np.repeat(np.arange(n), np.diff(bounds))
    at = np.arange(len(symbols)) - bounds[:-1][word]
    up, down = _powers(int(np.diff(bounds).max(initial=0)) + 2)
    with np.errstate(over="ignore"):
        term = symbols.astype(U) * up[at]
        sums = np.concatenate((np.zeros(1, U), np.cumsum(term)))
        own = sums[bounds[1:]] - sums[bounds[:-1]]
        before = sums[:-1] - sums[bounds[:-1]][word]  # what stands before each place
        after = own[word] - before - term
        rows, keys = [np.arange(n)], [own]
        # of a run of one symbol, one deletion is enough
        last = np.ones(len(symbols), bool)
        last[:-1] = (symbols[1:] != symbols[:-1]) | (word[1:] != word[:-1])
        rows.append(word[last])
        keys.append((before + after * down[1])[last])
        for symbol in range(1, n_symbols + 1):
            other = symbols != symbol if full else symbols < symbol
            rows.append(word[other])
            keys.append((before + after + U(symbol) * up[at])[other])
            if full:  # before each place, and at the end
                new = symbols != symbol
                rows += [word[new], np.arange(n)]
                keys += [(before + U(symbol) * up[at] + (after + term) * up[1])[new], own + U(symbol) * up[np.diff(bounds)]]
    return mix(own), np.concatenate(rows), mix(np.concatenate(keys))


def near_words(words: DataFrame, work, *, symbols: int = SYMBOLS) -> DataFrame:
    """``a, a_n, b, b_n`` of each two different words (rows ``word, n``) one edit apart, once a pair."""
    of_letter = symbols_of(words, symbols)
    table = np.zeros(256, np.int64)
    for letter, symbol in of_letter.items():
        table[ord(letter)] = symbol

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bounds = _reduce(batch.column(0).to_pylist(), table)
            keys, _, _ = neighbourhoods(found, bounds, 0)
            text = pa.array([found[a:b].astype(np.uint8).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.astype(np.int64)), text], names=["word", "n", "r", "reduced"])

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = part.column(1).to_pylist()
                found = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
                bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in texts], dtype=np.int64)))
                own, rows, keys = neighbourhoods(found, bounds, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)[rows]), pa.array(keys.astype(np.int64))], names=["r", "key"])

    listed = saved(work, words.select("word", "n").mapInArrow(reduced, "word string, n long, r long, reduced binary"), "reduced")
    vocabulary = listed.groupBy("r").agg(F.min("reduced").alias("reduced"))
    vocabulary = saved(work, vocabulary, "reduced-vocabulary")
    generated = vocabulary.select("r", "reduced").mapInArrow(generate, "r long, key long")
    met = generated.join(vocabulary.select(F.col("r").alias("key")), "key")
    a = listed.select("r", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = listed.select(F.col("r").alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    different = (F.col("r") != F.col("key")) | (F.col("a") < F.col("b"))
    return saved(work, met.join(a, "r").join(b, "key").where(different & one_edit).select("a", "a_n", "b", "b_n").distinct(), "near")


def _roots(forms: DataFrame, work) -> DataFrame:
    """``word, root`` of rows ``word, form``: pointers jump until none moves."""
    roots = work.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.frame.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = roots.frame.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = work.save(jumped, "roots", drop=("moved",), moved=F.count_if("moved"))
        work.drop(roots)
        roots = jumped
        if not roots.counts["moved"]:
            return roots.frame


def variants(docs: DataFrame, *, symbols: int = SYMBOLS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``."""
    if ratio < 2:
        raise ValueError("a form has to be more frequent than its word, so that forms cannot go in a circle")
    work = scratch(docs.sparkSession, "variants")
    words = saved(work, vocabulary(docs, least_length=least_length, least_count=least_count, id_col=id_col, text=text), "words")
    near = near_words(words, work, symbols=symbols)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("other")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("word")).alias("other")),
    )
    best = near.select(F.inline(ends)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("other"), F.first("n").alias("n"))
    frequent = -F.col("other.n") >= ratio * F.col("n")
    best = best.select("word", "n_near", F.when(frequent, F.col("other.word")).alias("form"), F.when(frequent, -F.col("other.n")).alias("form_n"))
    best = saved(work, best, "best")
    roots = _roots(best.where("form IS NOT NULL"), work)
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


#: Words one edit apart have a common string with one code point left out, at one place if they are of one length.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
),
bytes AS (
  SELECT doc_id, run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs
),
sums AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(range(0, length(h), 2), lambda p: CAST(('0x' || substr(h, p + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS crc
  FROM bytes, crc
),
spoiled AS (
  SELECT CASE WHEN crc % 31 = 0 THEN left(run, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM sums
),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
del AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM del x JOIN del y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM del x JOIN v y ON x.d = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM del x JOIN v y ON x.d = y.word
),
best AS (
  SELECT word, n, count(*) AS n_near, min((-other_n, hex(encode(other)), other)) AS o FROM pairs GROUP BY word, n
),
forms AS (
  SELECT word, n_near, CASE WHEN -o[1] >= 10 * n THEN o[3] END AS form, CASE WHEN -o[1] >= 10 * n THEN -o[1] END AS form_n FROM best
),
chain(word, root, steps) AS (
  SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, coalesce(r.root, v.word) AS root
FROM v LEFT JOIN forms USING (word) LEFT JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) r USING (word)
"""
