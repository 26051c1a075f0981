"""Line dedup: segment-partition edit join, in DataFrame functions only.

Two lines are alike if they are equal, or if their edit distance is at most ``tau`` and both have at
least ``least`` code points (in very short lines an edit changes everything).  ``tau`` is a number, or
steps of (least length of the longer line, edits), rising in both.  A line goes if an
earlier line, in the order of document id and line number, is equal to it or alike.

Of two lines within ``tau`` edits, one keeps at least one of the ``tau`` + 1 even segments of the
other unchanged, and only few places can hold it: those that leave the rest within the distance on both
sides.  So each distinct line is indexed under its segments (with length and segment number) and
probes, for each admissible shorter length, the substrings at those places.  Keys are looked at in two
steps: first the keys that more than one line has, by minimum and maximum, which combine before they
are shuffled; then the lines of these keys.  Candidates pass a bound on character counts inside the
join, and ``levenshtein`` with its threshold, which computes only the band around the diagonal,
verifies them.  The banded verification of Spark is used instead of a bit-parallel one: it is the form
that exists as a built-in function.

Equal lines are one class, so copies are never paired.  Classes are told apart by 128 bits of hash.

Defined cases: NULL text and lines without a word give no rows; line numbers count all lines from 0;
rows that repeat an id and a line are kept or dropped together; NULL ids come first; an empty table
gives an empty frame; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from islets.llm.shared import read, saved, scratch, whole

TAU = 1
LEAST = 20
#: Edits by the length of the longer line: one for each 20 code points, up to five (a word, a date).
STEPS = ((20, 1), (40, 2), (60, 3), (80, 4), (100, 5))
#: Groups of letters whose counts bound the edit distance.
GROUPS = ("en", "ta", "oi", "rs", "hd", "lu", "cm", " .")


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, line_no, line, h1, h2`` of each line that holds a word."""
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(whole(text), "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.reverse("line")).alias("h2"))


def _plan(low: int, steps: tuple[tuple[int, int], ...], least: int) -> list[tuple[int, int, int, int]]:
    """Keys of a line of ``low`` code points: ``tau``, how much shorter the other line is, segment, offset.

    A line is indexed for each ``tau`` that a line longer by up to ``tau`` has, and probes with its own.
    """
    found = []
    for k, (start, tau) in enumerate(steps):
        stop = steps[k + 1][0] if k + 1 < len(steps) else None
        if low < least or low < start - tau or (stop and low >= stop):
            continue
        for shorter in range(tau + 1 if low >= start else 1):
            for i in range(tau + 1):
                for off in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1):
                    own = shorter == 0 and off == 0
                    if own or (low >= start and low - shorter >= least):
                        found.append((tau, shorter, i, off))
    return found


def with_keys(lines: DataFrame, steps: tuple[tuple[int, int], ...], least: int) -> DataFrame:
    """Rows of ``lines`` for each ``key``; ``own``: whether it is a key of the line's own segments."""
    size = F.length("line")
    cuts = sorted({n for start, tau in steps for n in range(start - tau, start + tau + 1)} | set(range(least, least + steps[0][1] + 1)))
    plan, last = F.lit(None).cast("array<bigint>"), []
    for low in cuts:  # the plan is the same up to the next cut
        rows = [tau << 24 | shorter << 16 | i << 8 | off + tau for tau, shorter, i, off in _plan(low, steps, least)]
        if rows != last:
            plan, last = F.when(size >= low, F.expr(f"array({', '.join(f'{row}L' for row in rows)})")).otherwise(plan), rows
    keyed = lines.where(size >= least).withColumn("p", F.explode(plan))
    tau, shorter, i = (F.shiftright("p", n).bitwiseAND(F.lit(255)).cast("int") for n in (24, 16, 8))
    off = F.col("p").bitwiseAND(F.lit(255)).cast("int") - tau
    keyed = keyed.withColumns({"tau": tau, "shorter": shorter, "i": i, "off": off})
    length, parts = size - F.col("shorter"), F.col("tau") + 1
    # even segments; the last ones are longer by one
    short = F.floor(length / parts).cast("int")
    longer = length - short * parts
    at = F.col("i") * short + F.greatest(F.col("i") - parts + longer, F.lit(0)) + 1 + F.col("off")
    width = short + (F.col("i") >= parts - longer).cast("int")
    keyed = keyed.withColumns({"at": at.cast("int"), "width": width.cast("int")}).where((F.col("at") >= 1) & (F.col("at") + F.col("width") - 1 <= size))
    key = F.xxhash64("tau", length, "i", F.substring(F.col("line"), F.col("at"), F.col("width")))
    own = (F.col("shorter") == 0) & (F.col("off") == 0)
    return keyed.withColumns({"key": key, "own": own}).drop("p", "tau", "shorter", "i", "off", "at", "width")


def _bag(line: Column) -> Column:
    """Counts of the letter groups, a byte each."""
    out = F.lit(0).cast("long")
    for i, group in enumerate(GROUPS):
        n = F.length(line) - F.length(F.translate(line, group, ""))
        out = out.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(F.lit(255)), 8 * i))
    return out


def _bag_distance(a: Column, b: Column) -> Column:
    """At most twice the edit distance: differences of the counts, each modulo 256."""
    byte = lambda x, i: F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long"))
    parts = [F.abs(F.pmod(byte(a, i) - byte(b, i) + 128, F.lit(256)) - 128) for i in range(len(GROUPS))]
    return sum(parts[1:], parts[0])


def allowed(size: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    """The edits that a pair may have by the length of its longer line."""
    out = F.lit(0)
    for start, tau in steps:
        out = F.when(size >= start, tau).otherwise(out)
    return out


def similar_lines(lines: DataFrame, work, *, tau: int | tuple[tuple[int, int], ...] = TAU, least: int = LEAST) -> DataFrame:
    """Links between different lines: ``a1, a2, b1, b2`` (the two hashes of both, a before b)."""
    steps = ((least, tau),) if isinstance(tau, int) else tuple(tau)
    tau = max(t for _, t in steps)
    keyed = with_keys(lines.select("h1", "line"), steps, least).select("h1", "key", "own")
    met = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("own"))
    met = saved(work, met.where("own AND low <> high").select("key"), "keys")
    # few lines are left after the join, so letters are counted behind it
    again = with_keys(lines.select("h1", "h2", "line"), steps, least).select("h1", "h2", "line", "key", "own")
    again = again.join(met, "key", "left_semi").select("h1", "h2", _bag(F.col("line")).alias("bag"), "key", "own").distinct()
    again = saved(work, again, "probes")
    left = again.where("own").select("key", F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("bag").alias("xbag"))
    right = again.select("key", F.col("h1").alias("y1"), F.col("h2").alias("y2"), F.col("bag").alias("ybag"))
    x, y = (F.struct(F.col(f"{c}1").alias("h1"), F.col(f"{c}2").alias("h2")) for c in "xy")
    met_at = (left["key"] == right["key"]) & (x != y) & (_bag_distance(left["xbag"], right["ybag"]) <= 2 * tau)
    pairs = left.join(right, met_at).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    pairs = saved(work, pairs.select(*[F.col(f"{side}.h{i}").alias(f"{name}{i}") for side, name in (("a", "x"), ("b", "y")) for i in (1, 2)]), "pairs")
    wanted = saved(work, pairs.select(F.explode(F.array(F.struct("x1", "x2"), F.struct(F.col("y1").alias("x1"), F.col("y2").alias("x2")))).alias("w")).select(F.col("w.x1").alias("h1"), F.col("w.x2").alias("h2")).distinct(), "wanted")
    texts = lines.join(wanted, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    texts = saved(work, texts, "texts")
    a = texts.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("y1"), F.col("h2").alias("y2"), F.col("line").alias("b"))
    checked = pairs.join(a, ["x1", "x2"]).join(b, ["y1", "y2"]).where(F.levenshtein("a", "b", tau).between(0, allowed(F.greatest(F.length("a"), F.length("b")), steps)))
    return checked.select(F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("y1").alias("b1"), F.col("y2").alias("b2"))


def line_dedup(docs: DataFrame, *, tau: int | tuple[tuple[int, int], ...] = TAU, least: int = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: ``id, line_no, class_id, class_line, n_copies, n_links, kept``.

    The class is named by the place of the first of the equal lines; ``n_links`` counts the other
    classes within the distance.
    """
    work = scratch(docs.sparkSession, "line-dedup")
    lines = occurrences(docs, id_col=id_col, text=text)
    places = saved(work, lines.select("id", "line_no", "h1", "h2"), "places")
    classes = places.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    classes = saved(work, classes, "classes")
    links = saved(work, similar_lines(lines, work, tau=tau, least=least), "links")
    both = links.select(F.explode(F.array(F.struct("a1", "a2", "b1", "b2"), F.struct(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))).alias("l")).select("l.*")
    others = both.join(classes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("other")), ["b1", "b2"])
    others = others.groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("other"))
    known = saved(work, classes.join(others, ["h1", "h2"], "left"), "known")
    here = F.struct("id", "line_no")
    return places.join(known, ["h1", "h2"]).select(
        "id",
        "line_no",
        F.col("first.id").alias("class_id"),
        F.col("first.line_no").alias("class_line"),
        "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (here.eqNullSafe(F.col("first")) & (F.col("other").isNull() | (F.col("first") < F.col("other")))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"), tau=STEPS).withColumnRenamed("id", "doc_id")


#: The rule itself; pairs of lines of nearly one length are compared one by one.
SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, line FROM (
    SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
c AS (SELECT line, min((doc_id, line_no)) AS first, count(*) AS n_copies, length(line) AS n FROM l GROUP BY line),
-- two lines within one edit have equal first or equal second halves
h AS (SELECT *, left(line, n // 2) AS a, right(line, n // 2) AS b FROM c WHERE n >= 20),
e AS (
  SELECT x.line, y.line AS other, y.first FROM h x JOIN h y ON x.a = y.a AND x.n = y.n AND x.line <> y.line
  UNION SELECT x.line, y.line, y.first FROM h x JOIN h y ON x.b = y.b AND x.n = y.n AND x.line <> y.line
  UNION SELECT x.line, y.line, y.first FROM h x JOIN h y ON left(y.line, x.n // 2) = x.a AND y.n = x.n + 1
  UNION SELECT x.line, y.line, y.first FROM h x JOIN h y ON right(y.line, x.n // 2) = x.b AND y.n = x.n + 1
  UNION SELECT y.line, x.line, x.first FROM h x JOIN h y ON left(y.line, x.n // 2) = x.a AND y.n = x.n + 1
  UNION SELECT y.line, x.line, x.first FROM h x JOIN h y ON right(y.line, x.n // 2) = x.b AND y.n = x.n + 1
),
near AS (SELECT line, count(*) AS n_links, min(first) AS other FROM e WHERE levenshtein(line, other) <= 1 GROUP BY line)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first[1] AS class_id, CAST(first[2] AS INTEGER) AS class_line, n_copies,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, ((doc_id, line_no) = first AND (other IS NULL OR first < other)) AS kept
FROM l JOIN c USING (line) LEFT JOIN near USING (line)
"""

#: The rule of STEPS; counts of letters that differ by more than two an edit rule a pair out.
NEAR_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, line FROM (
    SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
c AS (SELECT line, min((doc_id, line_no)) AS first, count(*) AS n_copies, length(line) AS n FROM l GROUP BY line),
-- levenshtein counts bytes here: each further letter of the tables (up to 26) is written as an unused byte
u AS (SELECT string_agg(DISTINCT ch, '' ORDER BY ch) AS chars FROM (SELECT unnest(regexp_extract_all(line, '[^\x00-\x7F]')) AS ch FROM c)),
b AS (SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) AS bytes FROM generate_series(1, 31) g(i) WHERE i NOT BETWEEN 9 AND 13),
h AS (
  SELECT *, least(5, n // 20) AS tau, translate(line, (SELECT coalesce(chars, '') FROM u), (SELECT bytes FROM b)) AS single,
    length(line) - length(replace(line, 'e', '')) AS c_e,
    length(line) - length(replace(line, 'a', '')) AS c_a,
    length(line) - length(replace(line, 'o', '')) AS c_o,
    length(line) - length(replace(line, 'i', '')) AS c_i,
    length(line) - length(replace(line, 'n', '')) AS c_n,
    length(line) - length(replace(line, 'r', '')) AS c_r,
    length(line) - length(replace(line, 's', '')) AS c_s,
    length(line) - length(replace(line, 't', '')) AS c_t
  FROM c WHERE n >= 20
),
e AS (
  SELECT x.line AS a, x.first AS a_first, y.line AS b, y.first AS b_first
  FROM h x JOIN h y ON y.n BETWEEN x.n AND x.n + 5
  WHERE x.line <> y.line AND (x.n < y.n OR x.line < y.line) AND y.n - x.n <= y.tau
    AND abs(x.c_e - y.c_e) + abs(x.c_a - y.c_a) + abs(x.c_o - y.c_o) + abs(x.c_i - y.c_i) + abs(x.c_n - y.c_n) + abs(x.c_r - y.c_r) + abs(x.c_s - y.c_s) + abs(x.c_t - y.c_t) <= 2 * y.tau
    AND levenshtein(x.single, y.single) <= y.tau
),
near AS (
  SELECT line, count(*) AS n_links, min(first) AS other
  FROM (SELECT a AS line, b_first AS first FROM e UNION ALL SELECT b, a_first FROM e) GROUP BY line
)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first[1] AS class_id, CAST(first[2] AS INTEGER) AS class_line, n_copies,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, ((doc_id, line_no) = first AND (other IS NULL OR first < other)) AS kept
FROM l JOIN c USING (line) LEFT JOIN near USING (line)
"""
