"""HTML extraction by nearest-URL page differencing.

Pages are cut into text lines (blocks).  Within a host, pages are put in the order of their URL paths
and each is paired with the neighbour whose path has more in common with its own.  The lines of the
two are aligned by their longest common subsequence, and lines that both share are deleted as part of
the site's template.

Two rules of structure come on top, as the difference alone gives wrong results here.  Articles quote
each other and copies of an article stand at neighbouring URLs, so of the lines inside a marked article
(``article``, ``main``) that are shared with the neighbour's article, only template goes: the shared lines
at its start and end that recur in half of the different articles of the host, three at least, if most of
the article is left without them.  Where a page marks an article, nothing outside it is main text; in other pages, menus, headers, footers, asides, forms, and elements whose
class or id names a notice, an advert or comments are left out, because adverts and reader comments
differ from page to page.  Only lines that are neither in a marked article nor left out are compared,
on both sides, or, for a marked article, the lines of articles.  Lines are compared by their MD5, so that the
texts of neighbours need not travel.  If most of a page (in characters) is shared, the neighbour may be a copy, and a shared
line goes only if it is template: if it recurs in half of the host's different texts, and in three at
least.  A page all of whose lines would go keeps them.

Scale: URLs are ordered by a range shuffle, in which a large host falls into many parts; neighbours
across the edge of two parts are handed over, so the pairs do not depend on how pages are dealt out.
The lines of a page travel and lie on disk compressed, beside their digests.

Defined cases: NULL html is empty and gives the empty text; pages with a NULL or odd URL belong to the
host ``''``; equal URLs are ordered by page id, then content; repeated rows are pages like others (and
copies of each other); unclosed elements end with their parent; an empty table gives an empty frame.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Callable, Hashable, Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from islets.llm.shared import read, saved, scratch

#: Elements of HTML by what they mean for text.
HIDDEN = frozenset("script style noscript template textarea select svg math iframe object head title".split())
OUTSIDE = frozenset("nav header footer aside form dialog menu button".split())
ARTICLE = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening block of the same kind closes.
CLOSES = {"p": BLOCKS, "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",))}
#: Words in a class or id that mark an element as no part of the main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|"
    r"comments?|replies|disqus|respond|share|social|sidebar|related|breadcrumbs?|menu|navbar|nav|footer|header|masthead|pagination|pager)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: An article element that is no article of its own.
REPLIES = re.compile(r"comment|repl(?:y|ies)|related|sponsor|advert", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog".split())

IN_ARTICLE, PLAIN, OUT = 0, 1, 2
#: A template's line stands in at least so many different texts of a host: more than one pair.
RECUR = 3


def blocks(page: str) -> list[tuple[int, str]]:
    """The text blocks of a page: where they stand, and their text with white space made one blank."""
    found: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, kind, inside an article
    kind, inside = PLAIN, False

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            found.append((kind if kind == OUT else IN_ARTICLE if inside else PLAIN, line))

    def pop(upto: int) -> None:
        nonlocal kind, inside
        del stack[upto:]
        kind, inside = (stack[-1][1], stack[-1][2]) if stack else (PLAIN, False)

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if not token:
            text.append(page[at:])
            break
        text.append(page[at : token.start()])
        at = token.end()
        if not token.group(2):
            continue
        name = token.group(2).lower()
        if token.group(1):
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ARTICLE and name not in ("body", "html"):
                    break  # a stray end does not close the article around it
            continue
        if name in HIDDEN:  # skip to its end
            if name in ("head", "svg", "math", "object") or token.group(3).endswith("/"):
                if name != "head" and not token.group(3).endswith("/"):
                    close = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, at)
                    at = close.end() if close else end
                continue
            close = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            text.append(" ")
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
        while stack and name in CLOSES.get(stack[-1][0], ()):
            pop(len(stack) - 1)
        if name in BLOCKS and any(s[0] == "p" for s in stack[-4:]):  # a block ends an open paragraph, also one with open inline elements
            i = max(i for i in range(len(stack)) if stack[i][0] == "p")
            if not any(s[0] in BLOCKS for s in stack[i + 1 :]):
                pop(i)
        if token.group(3).endswith("/") and name not in BLOCKS:
            continue
        if name in OUTSIDE and not (inside and name == "header"):
            kind = OUT
        elif token.group(3) and kind != OUT:
            for value in _NAMES.findall(token.group(3)):
                value = "".join(value)
                if (name not in ARTICLE or REPLIES.search(value)) and name not in ("html", "body") and (MARKS.search(value) or value.lower() in _ROLES):
                    kind = OUT
        if name in ARTICLE and kind != OUT:
            inside = True
        stack.append((name, kind, inside))
    flush()
    return found


def shared_lines(left: list[Hashable], right: list[Hashable]) -> list[bool]:
    """For each line of ``left``, whether the longest common subsequence with ``right`` has it.

    The alignment is bit-parallel: one step of whole-number arithmetic for each line.
    """
    common = set(left) & set(right)
    mine = [i for i, line in enumerate(left) if line in common]
    theirs = [line for line in right if line in common]
    out = [False] * len(left)
    start = 0
    while start < len(mine) and start < len(theirs) and left[mine[start]] == theirs[start]:
        out[mine[start]] = True
        start += 1
    stop = 0
    while stop < len(mine) - start and stop < len(theirs) - start and left[mine[-1 - stop]] == theirs[-1 - stop]:
        out[mine[-1 - stop]] = True
        stop += 1
    mine, theirs = mine[start : len(mine) - stop], theirs[start : len(theirs) - stop]
    if not mine or not theirs:
        return out
    places: dict[Hashable, int] = {}
    for j, line in enumerate(theirs):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(theirs)) - 1
    row, rows = full, []
    for i in mine:  # a zero bit at j: one line more is common up to their line j
        rows.append(row)
        match = places.get(left[i], 0)
        u = row & match
        row = ((row + u) | (row - u)) & full
    j, after = len(theirs) - 1, row
    for k in range(len(mine) - 1, -1, -1):
        before = rows[k]
        low = (1 << (j + 1)) - 1
        if ((~after) & low).bit_count() > ((~before) & low).bit_count():  # this line is needed
            at = places[left[mine[k]]] & low
            while True:  # the last of their lines that gives the length
                j = at.bit_length() - 1
                rest = (1 << j) - 1
                if ((~before) & rest).bit_count() + 1 == ((~after) & low).bit_count():
                    break
                at &= rest
            out[mine[k]] = True
            j -= 1
        after = before
        if j < 0:
            break
    return out


def digest(line: str) -> bytes:
    """What stands for a line where lines of different pages are compared; Spark's ``unhex(md5(line))``."""
    return hashlib.md5(line.encode()).digest()


def _at_the_ends(gone: list[bool]) -> list[bool]:
    """Only the runs at the start and the end."""
    stay = [i for i, is_gone in enumerate(gone) if not is_gone]
    return [bool(stay) and (i < stay[0] or i > stay[-1]) for i in range(len(gone))]


def main_text(
    lines: list[tuple[int, str]],
    neighbour: list[Hashable] | None,
    template: Set[Hashable] = frozenset(),
    article: list[Hashable] | None = None,
    key: Callable[[str], Hashable] = str,
) -> str:
    """The main text of a page's blocks.

    ``neighbour`` are the plain lines of the neighbour, ``article`` the lines of its marked article and
    ``template`` the host's template among pages that are marked like this one, each line as ``key`` gives it.
    """
    marked = any(kind == IN_ARTICLE for kind, _ in lines)
    own = [line for kind, line in lines if kind == (IN_ARTICLE if marked else PLAIN)]
    keys = [key(line) for line in own]
    shared = shared_lines(keys, (article if marked else neighbour) or [])
    recurring = [gone and k in template for k, gone in zip(keys, shared)]
    if marked:
        shared = _at_the_ends(recurring)
    left = sum(len(line) for line, gone in zip(own, shared) if not gone)
    if 2 * left < sum(map(len, own)):  # not the page's main part: lines shared by this pair only may be a copy
        shared = [False] * len(own) if marked else recurring
    if all(shared):
        shared = [False] * len(own)
    return "\n\n".join(line for line, gone in zip(own, shared) if not gone)


def templates(pages: DataFrame) -> DataFrame:
    """``of, template_marked, template``: per host, the lines that recur in its articles, and the plain lines
    that recur in its other pages; rows ``host, marked, plain, article``.

    Counted in distinct texts: at least ``RECUR`` of them and half of the host's.  A host has at most twice
    its lines per text of them.
    """
    lines = F.when(F.col("marked"), F.col("article")).otherwise(F.col("plain"))
    texts = pages.select("host", "marked", lines.alias("lines")).withColumn("doc", F.xxhash64("lines")).dropDuplicates(["host", "marked", "doc"])
    sizes = texts.groupBy(F.col("host").alias("of"), F.col("marked").alias("template_marked")).agg(F.count(F.lit(1)).alias("docs"))
    counted = texts.select("host", "marked", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "marked", "line").agg(F.count(F.lit(1)).alias("n"))
    same = (F.col("host") == F.col("of")) & (F.col("marked") == F.col("template_marked"))
    counted = counted.where(F.col("n") >= RECUR).join(sizes, same).where(2 * F.col("n") >= F.col("docs"))
    return counted.groupBy("of", "template_marked").agg(F.collect_list("line").alias("template"))


def packed(lines: list[str]) -> bytes:
    """The lines as one compressed value; a line has no line feed, as its white space is blanks."""
    return zlib.compress("\n".join(lines).encode())


def unpacked(value: bytes) -> list[str]:
    """The lines again; no line is empty, so the empty text is no lines."""
    text = zlib.decompress(value).decode()
    return text.split("\n") if text else []


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, kinds, lines, packed`` of rows ``page_id, url, html``, without the lines that are OUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = [[x for x in blocks(page or "") if x[0] != OUT] for page in part.column(2).to_pylist()]
                kinds, lines = [[k for k, _ in f] for f in found], [[x for _, x in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(kinds, pa.list_(pa.int32())), pa.array(lines, pa.list_(pa.string())), pa.array([packed(x) for x in lines], pa.binary())],
                    names=["page_id", "url", "kinds", "lines", "packed"],
                )

    return pages.mapInArrow(run, "page_id long, url string, kinds array<int>, lines array<string>, packed binary")


def paired(lines: DataFrame, work) -> DataFrame:
    """Rows of ``parsed`` with the digests of the lines of the pages beside it (NULL at the host's ends) and of the host's template."""
    digests = lambda kind: F.transform(
        F.filter(F.arrays_zip("kinds", "lines"), lambda x: x.kinds == kind), lambda x: F.unhex(F.md5(x.lines))
    )
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    keyed = lines.withColumns(
        {
            "host": F.lower(F.when(F.col("url").contains("://"), F.regexp_extract(rest, r"^([^/?#]*)", 1)).otherwise("")),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            "tie": F.xxhash64("url", "kinds", "lines"),
            "plain": digests(PLAIN),
            "article": digests(IN_ARTICLE),
        }
    ).drop("lines")
    order = ["host", "path", "page_id", "tie"]
    parts = max(8, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")).drop("tie")
    # kept in buckets, so that the window over the parts shuffles no page again
    dealt = work.save(dealt, "sorted", buckets=("part", parts)).frame
    dealt = dealt.withColumn("marked", F.array_contains("kinds", IN_ARTICLE))
    # written, so that Spark knows its size before it plans the join: pages are shuffled only if it is large
    template = saved(work, templates(dealt), "templates")
    about = F.struct("host", "path", "plain", "article")
    in_part = Window.partitionBy("part").orderBy("pos")
    seen = dealt.withColumns({"before": F.lag(about).over(in_part), "after": F.lead(about).over(in_part)})
    # hand over the first and last page of each part to the parts beside it
    edges = dealt.groupBy("part").agg(F.min_by(about, "pos").alias("first"), F.max_by(about, "pos").alias("last"))
    edges = saved(work, edges, "edges")
    number = edges.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))  # one number per part
    number = saved(work, number.where("next IS NOT NULL"), "parts")
    lasts = edges.join(number, "part").select(F.col("next").alias("part"), F.col("last").alias("before_part"))
    firsts = number.join(edges.select(F.col("part").alias("next"), F.col("first").alias("after_part")), "next").select("part", "after_part")
    hand = dealt.select("part").distinct().join(lasts, "part", "left").join(firsts, "part", "left")
    hand = saved(work, hand, "handed")
    edge_rows = seen.where("before IS NULL OR after IS NULL").join(hand, "part", "left")
    edge_rows = edge_rows.withColumns({"before": F.coalesce("before", "before_part"), "after": F.coalesce("after", "after_part")})
    seen = seen.where("before IS NOT NULL AND after IS NOT NULL").unionByName(edge_rows.select(*seen.columns))
    seen = seen.join(template, (F.col("host") == F.col("of")) & (F.col("marked") == F.col("template_marked")), "left")
    return seen.select(
        "page_id",
        "url",
        "kinds",
        "packed",
        "path",
        F.when(F.col("before.host") == F.col("host"), F.struct("before.path", "before.plain", "before.article")).alias("before"),
        F.when(F.col("after.host") == F.col("host"), F.struct("after.path", "after.plain", "after.article")).alias("after"),
        "template",
    )


def _in_common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            return n
        n += 1
    return n


def extract(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``."""
    work = scratch(pages.sparkSession, "pages")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = []
                for row in part.select(["kinds", "packed", "path", "before", "after", "template"]).to_pylist():
                    sides = [s for s in (row["before"], row["after"]) if s]
                    nearest = max(sides, key=lambda s: _in_common(row["path"], s["path"])) if sides else {"plain": None, "article": None}
                    template = frozenset(row["template"] or ())
                    texts.append(main_text(list(zip(row["kinds"], unpacked(row["packed"]))), nearest["plain"], template, nearest["article"], digest))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return paired(parsed(rows), work).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
