"""Quality rules: cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed and counted in distinct documents per host.  Lines above a host's limit
are removed, and a document that keeps too little of itself is rejected, as is one that fails the
base rules (too few words, too much repetition).

Defined cases: NULL text counts as empty and fails the base rules; NULL hosts form one host; copies
of one text (in rows or documents) count as one document, so a group of copies does not make its
own lines frequent; rows are judged one by one, so repeated and tied rows get equal verdicts; an
empty table gives an empty frame; further columns pass through, and the columns added here replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from islets.llm.shared import safe_name, saved, scratch, whole, without_space, words

SYMBOLS = "#*$%&|<>"


def _lines(text: Column) -> Column:
    """The lines that hold a word, as they are."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _key(line: Column) -> Column:
    # blanks are by far the most common white space: texts without other white space skip the pattern
    return F.xxhash64(
        F.lower(F.trim(F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))
    )


def _with_repeats(frame: DataFrame, word: str, grams: str, placed: str, out: str) -> DataFrame:
    """Add ``out``: words inside three-word windows that occur at least twice, the first included.

    Windows are sorted by hash, so equal ones become neighbours: n log n, also for long texts.  Each
    step is a column that the next one names twice, so that the optimizer does not inline it.
    """
    n = F.greatest(F.size(word) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(word, F.lit(1), n), F.slice(word, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    frame = frame.withColumn(grams, F.zip_with(pairs, F.slice(word, F.lit(3), n), lambda a, b: F.xxhash64(a, b)))
    # only texts with a repeated window pay for the sort
    sort = F.sort_array(F.transform(grams, lambda gram, at: F.struct(gram.alias("g"), at.alias("i"))))
    frame = frame.withColumn(placed, F.when(F.size(F.array_distinct(grams)) < F.size(grams), sort))
    equal = F.filter(
        F.zip_with(placed, F.slice(placed, F.lit(2), F.size(placed)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda two: two.a.g == two.b.g,
    )
    covered = F.flatten(
        F.transform(equal, lambda two: F.array(two.a.i, two.a.i + 1, two.a.i + 2, two.b.i, two.b.i + 1, two.b.i + 2))
    )
    return frame.withColumn(out, F.when(F.col(placed).isNotNull(), F.size(F.array_distinct(covered))).otherwise(0).cast("long"))


def frequent_lines(
    docs: DataFrame, *, text: str = "text", host: str = "source", share: float = 0.05, least: int = 10
) -> DataFrame:
    """One row per host: ``host``, ``frequent`` (hashes of the lines above its limit).

    A line is above the limit if it stands in more than ``share`` of the host's distinct texts and
    in more than ``least`` of them.  A host has at most (its lines per text) / ``share`` such lines.
    """
    per_text = docs.select(F.col(host).alias("host"), F.xxhash64(whole(text)).alias("doc"), _lines(whole(text)).alias("lines"))
    sizes = per_text.groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    counted = (
        per_text.select("host", "doc", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count_distinct("doc").alias("n"))
        .where(F.col("n") > least)
    )
    sizes = sizes.withColumnRenamed("host", "of")
    return (
        counted.join(sizes, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("n") > F.col("docs") * share)
        .groupBy("host")
        .agg(F.collect_list("line").alias("frequent"))
    )


def line_frequency_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    share: float = 0.05,
    least: int = 10,
    keep_share: float = 0.2,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with counts, verdicts and ``clean_text`` (the text without frequent lines).

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_chars (code points in
    words of removed lines), base_failed, kept, clean_text.  ``kept`` is false if ``base_failed``, or
    if less than ``keep_share`` of the code points in words is left.
    """
    limits = frequent_lines(docs, text=text, host=host, share=share, least=least)
    own = ("host__", "frequent__", "body__", "lines__", "word__", "grams__", "placed__")
    of, frequent, body, lines, word, grams, placed = (safe_name(docs, x) for x in own)
    # written, so that Spark knows its size before it plans the join: texts are shuffled only if it is large
    limits = saved(scratch(docs.sparkSession, "quality-rules"), limits, "limits")
    limits = limits.select(F.col("host").alias(of), F.col("frequent").alias(frequent))
    joined = (
        docs.join(limits, docs[host].eqNullSafe(limits[of]), "left")
        .withColumn(body, whole(text))
        .withColumns({lines: _lines(F.col(body)), word: words(F.col(body))})
    )
    joined = _with_repeats(joined, word, grams, placed, "n_repeat_words")
    is_frequent = lambda line: F.array_contains(F.coalesce(F.col(frequent), F.array().cast("array<bigint>")), _key(line))
    t = F.col(body)
    counted = joined.withColumns(
        {
            "n_words": F.size(word).cast("long"),
            "word_chars": F.length(F.array_join(word, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "removed_chars": F.when(F.col(frequent).isNull(), 0)
            .otherwise(F.length(without_space(F.array_join(F.filter(lines, is_frequent), " "))))
            .cast("long"),
            "clean_text": F.when(F.col(frequent).isNull(), t).otherwise(
                F.array_join(F.filter(F.split(t, "\n"), lambda line: ~is_frequent(line) | ~line.rlike(r"[^\x20\x09-\x0D]")), "\n")
            ),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("word_chars") - F.col("removed_chars")
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= keep_share * F.col("word_chars")))
        .drop(of, frequent, body, lines, word, grams, placed)
    )


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def query(spark, sf_dir):
    from islets.llm.shared import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_frequency_rules(docs).select(*COLUMNS)


#: The verdicts on ``documents``; the pipeline's SQL reads it too.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h FROM documents),
w AS (
  SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a FROM d)
),
g AS (
  SELECT doc_id, i, CASE WHEN lead(w, 2) OVER p IS NOT NULL
    THEN w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p END AS g
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL)
  WHERE n > 1
),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
ln AS (
  SELECT doc_id, source, h, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k
  FROM (SELECT doc_id, source, h, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
),
often AS (
  SELECT source, k FROM ln JOIN (SELECT source, count(DISTINCT h) AS docs FROM d GROUP BY source) s USING (source)
  GROUP BY source, k, docs HAVING count(DISTINCT h) > 10 AND count(DISTINCT h) > docs * 0.05
),
gone AS (
  SELECT doc_id, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS removed
  FROM ln WHERE (source, k) IN (SELECT source, k FROM often) GROUP BY doc_id
),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed, 0) AS BIGINT) AS removed_chars
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN dup USING (doc_id)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - removed_chars >= 0.2 * word_chars) AS kept
FROM base
"""
