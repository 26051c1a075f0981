"""The text operators against brute force, SQL and odd tables."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from islets.llm import (
    best_positions,
    dart_minhash,
    exact_dedup,
    line_edit_join,
    mixing,
    packing,
    page_differencing,
    quadratic_discriminant,
    quality_rules,
    reduced_alphabet,
    registry,
    shared,
    substring_dedup,
    token_groups,
    toxic_neighbours,
)

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, host__ string, leaf__ string, class string"


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    long_text = _text(rng, 30_000)
    base = _text(rng, 200)
    texts = [
        None, "", "   \n\t ", "one", "one", "o n e", base, base, base + " tail", "intro words " + base, long_text,
        long_text + " more", "same line\n" * 30, "ü é 漢字 　 x", " ".join(["rep"] * 300), _text(rng, 60), _text(rng, 60),
    ]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src0", None, None, "h", None, "c") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6]]  # repeated rows
    rows += [(None, base, None, None, None, 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _operators(spark):
    labels = _labels(spark, [(1, 0, 0), (3, 1, None), (4, None, 1), (6, 1, 1), (6, 1, 1), (7, 0, 0), (99, 1, 1), (None, 1, 1)])
    return {
        "substring": lambda d: substring_dedup.substring_dedup(d),
        "exact": lambda d: exact_dedup.stateful_dedup(d),
        "mixing": lambda d: mixing.mixture(d, mixing.levels_of_documents())[0],
        "packing": lambda d: packing.pack(d, packing.tokenizer_path()),
        "pages": lambda d: page_differencing.extract(d.withColumn("html", F.col("text")), id_col="doc_id", url="source"),
        "rules": lambda d: quality_rules.line_frequency_rules(d),
        "near": lambda d: dart_minhash.near_duplicates(d),
        "quality": lambda d: quadratic_discriminant.classify(d, labels, "quality"),
        "lines": lambda d: line_edit_join.line_dedup(d),
        "toxic": lambda d: toxic_neighbours.classify(d, labels, "toxic"),
    }


@pytest.mark.parametrize("name", ["substring", "exact", "mixing", "pages", "rules", "near", "quality", "toxic"])
def test_one_row_for_each_odd_row(spark, odd, name):
    found = _operators(spark)[name](odd).collect()
    assert len(found) == odd.count()


@pytest.mark.parametrize("name", ["substring", "exact", "mixing", "packing", "pages", "rules", "near", "quality", "lines", "toxic"])
def test_empty_table(spark, none, name):
    assert _operators(spark)[name](none).collect() == []


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF_DIR)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


# op1


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(6)]
    passages = [[rng.choice(pool) + str(rng.randint(0, 9)) for _ in range(rng.randint(15, 60))] for _ in range(5)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages)
            a = rng.randint(0, 10)
            words += part[a : a + rng.randint(5, 60)] if rng.random() < 0.7 else [rng.choice(pool) for _ in range(20)]
        docs.append((i, "\n ".join(words)))
    for window in (20, 50):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        found = {r.id: r for r in substring_dedup.substring_dedup(frame, window=window).collect()}
        first = {}
        for i, text in docs:
            words = text.split()
            for s in range(len(words) - window + 1):
                first.setdefault(tuple(words[s : s + window]), i)
        for i, text in docs:
            words = text.split()
            gone = set()
            for s in range(len(words) - window + 1):
                if first[tuple(words[s : s + window])] < i:
                    gone.update(range(s, s + window))
            assert found[i].n_words == len(words) and found[i].n_removed == len(gone)
            assert found[i].kept_text == " ".join(w for j, w in enumerate(words) if j not in gone)


def test_words_built_to_collide_are_told_apart(spark):
    """Thue-Morse words and their complements have equal polynomials modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {other}"), (3, f"{head} {one}")], "doc_id long, text string")
    found = {r.id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 50}


# op2


def test_stream_goes_on_from_its_state(spark, tmp_path):
    rows = [(1, "a b"), (2, "ab"), (3, "c")]
    for name, part in (("one", rows[:2]), ("two", rows[2:] + [(4, "a  b")])):
        arrived = exact_dedup.arrivals(spark.createDataFrame(part, "doc_id long, text string"))
        arrived.write.mode("append").parquet(str(tmp_path / "in"))
        groups = exact_dedup.fold(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), 1)
        found = sorted((-r.stays.order, r["size"]) for r in groups.collect())
        assert found == ([(1, 2)] if name == "one" else [(3, 1), (4, 3)])


def test_a_digest_of_several_texts_is_split(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, " a")], "doc_id long, text string")
    found = exact_dedup._by_text(docs, "doc_id", "text").select("id", (-F.col("stays.order")).alias("keep"), "size").collect()
    assert sorted(map(tuple, found)) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


# op3


def _fill(children, budget):
    """Water filling by repeated passes; children: name -> (weight, limit)."""
    got = dict.fromkeys(children, 0.0)
    open_ = {c for c, (w, limit) in children.items() if w > 0 and limit > 0}
    while open_ and budget > 1e-9:
        weight = sum(children[c][0] for c in open_)
        full = {c for c in open_ if got[c] + budget * children[c][0] / weight >= children[c][1] - 1e-9}
        if not full:
            for c in open_:
                got[c] += budget * children[c][0] / weight
            return got
        spare = budget
        for c in full:
            spare -= children[c][1] - got[c]
            got[c] = children[c][1]
        open_ -= full
        for c in open_:  # start over with the rest
            spare += got[c]
            got[c] = 0.0
        budget = spare
    return got


def test_budgets_match_water_filling(spark):
    rng = random.Random(2)
    leaves = [(f"d{i % 3}", f"l{i % 4}", f"s{i}", rng.choice([0, 5, 40, 300, 2000])) for i in range(24)]
    sizes = spark.createDataFrame(leaves, "a string, b string, c string, tokens long")
    weights = spark.createDataFrame([(["d0"], 3.0), (["d1", "l1"], 0.5), (["d2"], 0.0)], "path array<string>, weight double")
    w = {("d0",): 3.0, ("d1", "l1"): 0.5, ("d2",): 0.0}
    total = sum(x[3] for x in leaves)
    for share, epochs in ((0.3, 1), (0.9, 2), (3.0, 2)):
        found = {r.leaf: r.budget for r in mixing.leaf_budgets(sizes, ["a", "b", "c"], budget=F.lit(share * total), max_epochs=epochs, weights=weights).collect()}
        budgets = {(): min(share * total, epochs * total)}
        for depth in (1, 2, 3):
            children = defaultdict(lambda: defaultdict(float))
            for leaf in leaves:
                children[leaf[: depth - 1]][leaf[:depth]] += leaf[3] * epochs
            budgets |= {k: v for p, own in children.items() for k, v in _fill({c: (w.get(c, 1.0), limit) for c, limit in own.items()}, budgets[p]).items()}
        import json

        for leaf in leaves:
            assert abs(found[json.dumps(list(leaf[:3]), separators=(",", ":"))] - budgets[leaf[:3]]) <= 1.001


def test_leaves_take_the_longest_prefix_in_seeded_order(spark):
    rng = random.Random(3)
    docs = [(i, _text(rng, rng.randint(0, 40)), "en", f"src{rng.choice([0, 0, 0, 1, 2])}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows, plan = mixing.mixture(frame, [F.col("lang"), F.col("source")], share=0.8, max_epochs=2, seed=4)
    copies = {r.doc_id: r.copies for r in rows.collect()}
    ordered = rows.select("doc_id", "source", mixing._node([F.col("lang"), F.col("source")]).alias("leaf"), *[F.xxhash64(F.lit(4), F.lit(e).cast("long"), "doc_id").alias(f"o{e}") for e in (0, 1, 2)]).collect()
    n = {i: len(t.split()) for i, t, _, _ in docs}
    for p in plan.collect():
        own = [r for r in ordered if r.leaf == p.leaf]
        assert p.tokens == sum(n[r.doc_id] for r in own)
        rest = p.budget - p.whole_epochs * p.tokens
        taken, used = set(), 0
        for r in sorted(own, key=lambda r: r[f"o{p.whole_epochs}"]):
            used += n[r.doc_id]
            if used > rest or p.whole_epochs >= 2:
                break
            taken.add(r.doc_id)
        assert {r.doc_id for r in own if copies[r.doc_id] > p.whole_epochs} == taken
        assert all(copies[r.doc_id] in (p.whole_epochs, p.whole_epochs + 1) for r in own)
        assert sum(n[r.doc_id] * copies[r.doc_id] for r in own) <= p.budget


# op4


def test_packing_is_a_whole_round_trip(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(100, "a  b \n c"), (101, "<|endoftext|> don't"), (103, "hi <|endoftext|><|endoftext|> there <|endoftext|>"), (102, "   x\n\ny  ")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").where("doc_id is not null").distinct().unionByName(extra)
    found = packing.pack(docs, packing.tokenizer_path()).collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in found:
        part = np.array(ids[r.id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and 0 < r.length <= 1024
        pieces[r.id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for key, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(itertools.accumulate([0] + [r.length for r in own[:-1]]))
        assert sum(r.length for r in own) == len(ids[key]) and all(r.length == 1024 for r in own[1:])
        assert len(own) == -(-len(ids[key]) // 1024)
    assert set(pieces) == set(ids)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == list(itertools.accumulate([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) <= 1024
    assert len(places) <= -(-sum(map(len, ids.values())) // 1024) + 1


def test_pack_sizes_is_close_to_the_lower_bound():
    rng = random.Random(8)
    for n in (0, 1, 50, 5000, 200_000):
        counts = Counter(rng.randint(1, 1023) for _ in range(n))
        layout, bins = packing.pack_sizes(counts)
        assert sum(b - a for _, a, b, _, _ in layout) == n
        low = -(-sum(s * c for s, c in counts.items()) // 1024)
        assert low <= bins <= low * 1.01 + 3


# op5


def test_pages():
    page = (
        "<html><head><title>T</title></head><body><header>Top</header><nav><a>Menu</a></nav><div class='cookie-notice'>Cookies</div>"
        "<article><h1>Title &amp; more</h1><p>One<br>two\n three<p>Four <b>five</p><aside>Ad</aside><script>var x='</p>';</script>"
        "<div class=comments><p>Reader</div></article><form>Form</form><footer>&copy; us"
    )
    assert page_differencing.main_text(page_differencing.blocks(page), None) == "Title & more\n\nOne two three\n\nFour five"
    assert page_differencing.blocks("") == [] and page_differencing.main_text([], None) == ""


def test_template_inside_marked_articles_goes(spark):
    def page(i, *middle):
        lines = ("Subscribe to this site", *middle, "Thanks for reading")
        return (i, f"http://h/a/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>")

    own = {i: f"Story number {i} has its own long words: " + "abcdefgh"[i] * 60 for i in range(6)}
    pages = [page(i, own[i], "A quote that all stories have.", own[i][::-1]) for i in range(6)]
    # two articles of a host are no template, nor are copies, nor is most of an article
    pages += [(10 + i, f"http://k/{i}", f"<main><p>Shared</p><p>{own[i]}</p></main>") for i in range(2)]
    pages += [(20 + i, f"http://m/{i}", f"<main><p>{own[0]}</p><p>{i}</p></main>") for i in range(4)]
    pages += [(30 + i, f"http://n/{i}", f"<main><p>{own[1]}</p></main>") for i in range(4)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text.split("\n\n") for r in page_differencing.extract(frame).collect()}
    for i in range(6):
        assert found[i] == [own[i], "A quote that all stories have.", own[i][::-1]]
    assert all(found[10 + i] == ["Shared", own[i]] for i in range(2))
    assert all(found[20 + i] == [own[0], str(i)] for i in range(4))
    assert all(found[30 + i] == [own[1]] for i in range(4))


def test_lines_shared_with_the_nearest_page_go(spark):
    pages = [(i, f"http://h.example/a/{i}", f"<div>Site</div><div>Text {i}</div><div>Imprint</div>") for i in range(30)]
    pages += [(90, None, None), (91, "http://alone.example/", "<p>Site<p>Own"), (92, "x", "&lt;b&gt; <b>bold")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in page_differencing.extract(frame).collect()}
    assert [found[i] for i in range(30)] == [f"Text {i}" for i in range(30)]
    assert (found[90], found[91], found[92]) == ("", "Site\n\nOwn", "<b> bold")


def test_copied_articles_keep_their_text(spark):
    rng = random.Random(14)
    article = [_text(rng, 20) for _ in range(6)]
    site = lambda body, advert: f"<nav>Menu</nav><div>Site</div>{body}<div class=advert>{advert}</div><div>Imprint</div>"
    whole = lambda lines: "".join(f"<p>{line}</p>" for line in lines)
    near = article[:2] + ["changed"] + article[3:]
    pages = [(0, "http://a.example/x/1", site(whole(article), "Buy")), (1, "http://a.example/x/2", site(whole(article), "Sell"))]
    pages += [(2, "http://b.example/x/1", site(whole(article), "Buy")), (3, "http://b.example/x/2", site(whole(near), "Sell"))]
    pages += [(4, "http://c.example/x/1", site(whole(article), "Buy")), (5, "http://c.example/x/2", site(f"<article>{whole(article)}</article>", "Sell"))]
    pages += [(10 + i, f"http://d.example/x/{i}", site(whole(article if i < 2 else near if i == 2 else [_text(rng, 20)]), f"Ad {i}")) for i in range(12)]
    found = {r.page_id: r.text.split("\n\n") for r in page_differencing.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, lines in {0: article, 1: article, 2: article, 3: near, 4: article, 5: article, 10: article, 11: article, 12: near}.items():
        assert [x for x in found[i] if x not in ("Site", "Imprint")] == lines
        assert "Site" not in found[i] or i in (0, 1, 2, 3)
    assert all("Site" not in found[10 + i] and len(found[10 + i]) == 1 for i in range(3, 12))


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        chosen = [x for x, shared in zip(a, page_differencing.shared_lines(a, b)) if shared]
        rest = iter(b)
        assert len(chosen) == table[-1][-1] and all(x in rest for x in chosen)


# op6


def test_copies_do_not_make_lines_frequent(spark):
    rng = random.Random(9)
    clean = [_text(rng, 80) for _ in range(60)]
    rows = [(i, t + ("\nShared  BANNER" if i % 2 else "\nshared banner"), "a") for i, t in enumerate(clean)]
    rows += [(100 + i, clean[0] + "\nunique end", "a") for i in range(50)]  # copies
    rows += [(200, "shared banner " * 1, "a")]
    found = {r.doc_id: r for r in quality_rules.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i].kept and found[i].clean_text == clean[i] for i in range(60))
    assert all(found[100 + i].kept for i in range(50)) and not found[200].kept


# op7


def _groups(texts, threshold=0.8, width=5):
    sets = {}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[i] = frozenset(tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1)))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for base in range(12):
        words = _text(rng, rng.choice([3, 12, 80, 300])).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 999))
            texts.append((len(texts), " ".join(copy)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.id: r.group_id for r in dart_minhash.near_duplicates(frame).collect()}
    assert found == _groups(texts)


def test_dart_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(4)
    names = dart_minhash.mix(np.arange(400, dtype=np.uint64))
    a, b = rng.integers(0, 5, 400).astype(float), rng.integers(0, 5, 400).astype(float)
    elements, weights, owner = np.concatenate([names, names]), np.concatenate([a, b]), np.repeat([0, 1], 400)
    real = weights > 0
    signed = dart_minhash.signatures(elements[real], weights[real], owner[real], 2, 2048)
    assert abs((signed[0] == signed[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# op8, op10


@pytest.mark.parametrize("name, label, least", [("op8_quadratic_discriminant", "quality", 0.97), ("op10_toxic_neighbours", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    found = registry.queries()[name](spark, folder)
    found = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


def test_block_max_search_is_exact():
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(40)]
    examples = [(i, rng.randint(0, 1), {rng.choice(vocabulary): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}) for i in range(900)]
    idf = {t: rng.random() + 0.1 for t in vocabulary}
    index = toxic_neighbours.BlockMaxIndex(idf, examples)
    for _ in range(100):
        query = {rng.choice(vocabulary): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        at, values = index.vector(query)
        mine = dict(zip(at.tolist(), values))
        exact = []
        for key, y, counts in examples:
            cosine = sum(v * mine.get(int(t), 0.0) for t, v in zip(*index.vector(counts)))
            if cosine > 0:
                exact.append((round(float(cosine), 9), -key))
        best = sorted(exact, reverse=True)[:15]
        assert [round(c, 9) for c, _, _ in index.nearest(query)] == [c for c, _ in best]


def test_block_max_search_leaves_blocks_unread():
    """Examples of 20 rare terms: a text of one of them reads its blocks, not those that only hold the common term."""
    rng = random.Random(7)
    examples = [(i, i % 2, {f"t{i % 20}": 3, "common": 1}) for i in range(4000)]
    idf = {f"t{i}": 3.0 for i in range(20)} | {"common": 0.1}
    index = toxic_neighbours.BlockMaxIndex(idf, examples)
    for _ in range(20):
        t = rng.randrange(20)
        near = index.nearest({f"t{t}": 3, "common": 1})
        assert [key for _, key, _ in near] == [t + 20 * i for i in range(15)]
    assert index.opened < 20 * index.blocks / 4


def test_toxicity_matches_brute_force(spark):
    """The whole query: terms chosen, weights, cosines, the nearest examples and scores, with copies and odd rows."""
    rng = random.Random(8)
    bad, plain = [f"vile{c}" for c in "abcdef"], [f"calm{c}{d}" for c in "abcdefgh" for d in "xyz"]
    texts = {}
    for i in range(240):
        body = [rng.choice(plain) for _ in range(rng.randint(0, 30))]
        body += [rng.choice(bad) for _ in range(rng.randint(1, 4))] if i % 3 == 0 and rng.random() < 0.9 else []
        texts[i] = " ".join(body)
    texts[12] = texts[9] = texts[6]
    texts[30] = None
    labelled = {i: int(i % 3 == 0) for i in texts if i % 7}
    docs = spark.createDataFrame(list(texts.items()) + [(6, texts[6]), (None, "vilea")], "doc_id long, text string").repartition(5)
    labels = _labels(spark, [(i, 0, y) for i, y in labelled.items()] + [(6, 0, 1)])
    found = toxic_neighbours.classify(docs, labels, "toxic").collect()
    assert len(found) == len(texts) + 2

    learn = {i: y for i, y in labelled.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    counts = {i: toxic_neighbours.terms(t or "") for i, t in texts.items()}
    distinct = {(y, frozenset(counts[i])): i for i, y in learn.items()}
    total, n1 = len(distinct), sum(y for y, _ in distinct)
    n0, idf = total - n1, {}
    for term in {t for _, s in distinct for t in s}:
        a, b = (sum(term in s for y, s in distinct if y == label) for label in (1, 0))
        cells = [(a, (a + b) * n1), (b, (a + b) * n0), (n1 - a, (total - a - b) * n1), (n0 - b, (total - a - b) * n0)]
        ratio = 2 * sum(x * math.log(x * total / e) for x, e in cells if x > 0)
        if a > 1 and a / n1 > toxic_neighbours.LEAST_LIFT * b / n0 and ratio >= toxic_neighbours.LEAST_RATIO:
            idf[term] = math.log((total + 1) / (a + b + 0.5))
    assert idf

    def unit(words):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in words.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {i: unit(counts[i]) for i in learn}
    silent = [learn[i] for i, v in examples.items() if not v]
    prior = sum(silent) / len(silent)
    for row in found:
        v = unit(toxic_neighbours.terms("vilea") if row.id is None else counts[row.id])
        near = sorted((-round(sum(x * e.get(t, 0.0) for t, x in v.items()), 12), i) for i, e in examples.items())
        near = [(-c, i) for c, i in near if c < 0][: toxic_neighbours.NEIGHBOURS]
        weight = toxic_neighbours.PRIOR_WEIGHT
        score = (sum(c * learn[i] for c, i in near) + weight * prior) / (sum(c for c, _ in near) + weight)
        assert abs(row.score - score) < 1e-9
        assert row.neighbours == [i for _, i in near]


def test_every_different_labelled_text_counts_for_terms(spark):
    shared = min((f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)), key=lambda t: zlib.crc32(t.encode()))
    names = ["x" + chr(97 + i) + chr(97 + j) for i in range(26) for j in range(2)]
    rows = [(i, i % 2, f"{shared} {name}" + " bad" * (i % 2)) for i, name in enumerate(names)]
    rows += [(100 + i, 1, f"{shared} copied bad") for i in range(9)]
    examples = toxic_neighbours._term_counts(spark.createDataFrame(rows, "id long, y int, text string"))
    assert examples.select("y", "copy").distinct().count() == len(names) + 1
    assert "bad" in {r.term for r in toxic_neighbours.choose_terms(examples).collect()}


def test_without_labels(spark, odd):
    empty = _labels(spark, [])
    assert {r.score for r in quadratic_discriminant.classify(odd, empty, "quality").collect()} == {0.5}
    assert {r.score for r in toxic_neighbours.classify(odd, empty, "toxic").collect()} == {0.0}


# op9


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_line_dedup_matches_brute_force(spark, tau):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 14))) for _ in range(10)]

    def edited(text):
        out = list(text)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(out))
            if rng.random() < 0.5:
                out.insert(i, rng.choice("abcdé"))
            elif out:
                out[min(i, len(out) - 1)] = rng.choice("abcd")
        return "".join(out)

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(5))) for i in range(40)] + [(60, None), (61, "")]
    found = {(r.id, r.line_no): r for r in line_edit_join.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), tau=tau, least=4).collect()}
    lines = {(i, n): x for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip()}
    assert set(found) == set(lines)
    first = {}
    for key in sorted(lines):
        first.setdefault(lines[key], key)
    for key, line in lines.items():
        near = [y for y in first if y != line and min(len(line), len(y)) >= 4 and _distance(line, y) <= tau]
        assert (found[key].class_id, found[key].class_line) == first[line] and found[key].n_links == len(near)
        assert found[key].kept == (first[line] == key and all(first[y] > key for y in near))


def test_registered_line_joins_link_a_changed_word(spark, tmp_path):
    rng = random.Random(12)
    line = _text(rng, 30)
    rows = [(1, line), (2, "on 12 May " + line), (3, "on 27 July " + line), (4, _text(rng, 30)), (5, "a short line of 1 rule"), (6, "a short line of 23 rules")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(rows)
    near = {i: [j for j in texts if j != i and _distance(texts[i], texts[j]) <= min(5, max(len(texts[i]), len(texts[j])) // 20)] for i in texts}
    assert any(near.values()) and not near[5]
    found = [registry.queries()[name](spark, str(tmp_path)).collect() for name in registry.queries() if name.startswith("op9_")]
    assert any({r.doc_id: r.n_links for r in rows} == {i: len(n) for i, n in near.items()} for rows in found)


@pytest.mark.parametrize("steps", [((4, 1), (7, 2), (10, 3)), ((4, 1), (6, 3))])
def test_line_dedup_with_edits_by_length_matches_brute_force(spark, steps):
    rng = random.Random(4)
    lines = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(3, 13))).strip() + "x" for _ in range(150)})
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.id: r.n_links for r in line_edit_join.line_dedup(frame, tau=steps, least=4).collect()}
    edits = lambda n: max((t for start, t in steps if n >= start), default=0)
    for i, a in enumerate(lines):
        assert found[i] == sum(b != a and min(len(a), len(b)) >= 4 and _distance(a, b) <= edits(max(len(a), len(b))) for b in lines)


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(i == g for i, g in _groups(texts).items())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.where("length > 1024 or length < 1").isEmpty()


def test_pipeline_drops_frequent_lines(spark):
    import corpus_pipeline

    rng = random.Random(9)
    clean = [_text(rng, 80) for _ in range(40)]
    rows = [(i, t + "\nShared banner", "en", "a", len(t) + 14) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.STAGES[0][1](spark, docs, SF_DIR)
    assert found.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text, r.n_chars) for r in found.collect()) == [(i, t, len(t)) for i, t in enumerate(clean)]


def test_odd_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sizes = [0, 1, 5, 300, 512, 513, 3000] * 200
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in sizes]
    owner = np.repeat(np.arange(len(sets)), sizes)
    level, odd = dart_minhash.odd_sketches(np.concatenate(sets), owner, len(sets))
    assert [int(x) for x in level[:7]] == [0, 0, 0, 0, 0, 1, 2]
    half = dart_minhash.ODD // 64
    for i in range(0, len(sets) - 8, 7):
        for a, b in ((i + 2, i + 3), (i + 3, i + 4), (i + 4, i + 11), (i, i + 1)):
            bits = sum(int(x).bit_count() for x in (odd[a, :half] ^ odd[b, :half]).view(np.uint64))
            assert bits <= len(np.setxor1d(sets[a], sets[b]))
    empty = dart_minhash.odd_sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    assert len(empty[0]) == 0 and empty[1].shape == (0, 2 * half)


# pipeline


def test_rules_stage_works_out_each_rule_once(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = corpus_pipeline.rules(spark, docs, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "c", "en", "s", 1), (2, "ab", "en", "s", 2), (None, "d", None, None, None), (None, "d", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.exact(spark, docs, SF_DIR).select("doc_id", "text").collect()
    assert sorted(map(tuple, found), key=repr) == [(1, "a b"), (1, "c"), (None, "d")]


def test_exact_stage_shuffles_texts_once(spark):
    import corpus_pipeline

    rows = [(i % 40, f"text {i % 30}" + " " * (i % 3), "en", f"s{i % 2}", 9) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = corpus_pipeline.exact(spark, docs, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert sum("lang" in line or "row__" in line for line in plan.split("\n") if "Aggregate(" in line and "partial_min" in line) == 1
    assert plan.count("Exchange hashpartitioning") <= 4
    best = {}
    for i, text, lang, source, n in sorted(rows, key=lambda r: (-len(r[1]), r[0], r[1:])):
        best.setdefault(re.sub(r"\s", "", text), (i, text, lang, source, n))
    assert sorted(map(tuple, frame.collect())) == sorted(best.values())


def test_exact_stage_combines_rows_of_a_null_id(spark):
    import corpus_pipeline

    rows = [(None, "a b", None, None, None), (None, "a  b", "en", "s", 4), (0, "c", "en", "s", 1), (None, "d", "en", "s", 1), (0, "d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.exact(spark, docs, SF_DIR)
    assert found.dtypes == docs.dtypes
    assert sorted(map(tuple, found.collect()), key=repr) == [(0, "c", "en", "s", 1), (0, "d", "en", "s", 1), (None, "a  b", "en", "s", 4)]


def test_stages_take_an_empty_table(spark, none):
    import corpus_pipeline

    docs = none.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []


# op7 and op13: tasks and batches


def _near_copies(spark, n):
    rng = random.Random(12)
    texts = [_text(rng, 60) for _ in range(n)]
    rows = [(k * n + i, t + " tail" * k) for i, t in enumerate(texts) for k in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_small_tables_take_no_more_tasks_than_cores(spark, monkeypatch):
    from islets.plans.workspace import Workspace

    fixed = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    files, save = {}, Workspace.save

    def counted(self, frame, name, **more):
        table = save(self, frame, name, **more)
        files[name] = max(files.get(name, 0), len(table.frame.inputFiles()))
        return table

    monkeypatch.setattr(Workspace, "save", counted)
    with shared.settings(spark, fixed):
        found = dart_minhash.near_duplicates(_near_copies(spark, 60)).collect()
    assert len(found) == 180 and len({r.group_id for r in found}) == 60
    cores = spark.sparkContext.defaultParallelism
    assert {"classes", "members", "links", "labels", "edges", "large_star", "small_star", "groups"} <= set(files)
    assert max(files.values()) <= cores


def test_lines_of_pages_travel_packed(spark, monkeypatch):
    from islets.plans.workspace import Workspace

    rng = random.Random(23)
    assert all(page_differencing.unpacked(page_differencing.packed(x)) == x for x in ([], ["a"], ["\u00e9 b", "\U0001f600", "a"]))
    columns, save = {}, Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, frame, name, **more: columns.update({name: frame.columns}) or save(self, frame, name, **more))
    texts = [[_text(rng, 60) for _ in range(3)] for _ in range(8)]
    pages = [(i, f"http://x.org/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>") for i, lines in enumerate(texts)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in page_differencing.extract(frame).collect()}
    assert found == {i: "\n\n".join(" ".join(x.split()) for x in lines) for i, lines in enumerate(texts)}
    assert "packed" in columns["sorted"] and "lines" not in columns["sorted"]


def test_token_groups_hand_few_rows_to_python_at_a_time(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, overlaps, unions = [], token_groups._overlaps, token_groups._unions
    before = spark.conf.get(name)
    monkeypatch.setattr(token_groups, "_overlaps", lambda *a: seen.append(int(spark.conf.get(name))) or overlaps(*a))
    monkeypatch.setattr(token_groups, "_unions", lambda *a: seen.append(int(spark.conf.get(name))) or unions(*a))
    found = token_groups.jaccard_components(_near_copies(spark, 20)).collect()
    assert len(found) == 60 and len({r.component_id for r in found}) == 20
    assert seen and max(seen) <= 64 and spark.conf.get(name) == before


# op11


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_search_matches_brute_force(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(WORDS[: rng.randint(2, 19)]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "Alpha-BETA, gamma\u00c9 x"), (402, "alpha beta"), (None, "alpha beta")]
    items = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 6)))) for i in range(30)] + [(30, None), (31, "unknown"), (2, "alpha"), (None, "beta BETA")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = best_positions.search(frame, asked, block_terms=20).collect()
    counted = [(key, Counter(_terms(text))) for key, text in docs if _terms(text)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for key, text in items:
        wanted[key] |= set(_terms(text))
    want = []
    for item, terms in wanted.items():
        scored = []
        for key, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, key is None, key))
        want += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:10], 1)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_best_positions_stop_early():
    rng = np.random.default_rng(3)
    n = 20_000
    doc = np.concatenate([np.arange(n)] * 3)
    term = np.repeat(np.arange(3), n)
    score = (rng.pareto(1.0, 3 * n) * 1000).astype(np.int64) + 1
    index, best = best_positions.ImpactLists(term, doc, score), best_positions.Best(10)
    looked = index.search(np.arange(3), best, np.zeros(n, bool), np.arange(n))
    total = np.bincount(doc, score).astype(np.int64)
    assert best.rows[2].tolist() == np.lexsort((np.arange(n), -total))[:10].tolist()
    assert looked < n / 10


def test_search_of_empty_tables(spark, none, odd):
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert best_positions.search(none, asked).collect() == []
    assert best_positions.search(odd, asked.where("false")).collect() == []
    assert len(best_positions.search(odd, asked).collect()) == 2  # "o n e" has other terms


# op12


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_variants_match_brute_force(spark):
    rng = random.Random(12)
    letters = "abcde\u00e9\u00df"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(25)]

    def spoil(word):
        i = rng.randrange(len(word))
        return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])

    docs = []
    for i in range(150):
        words = [rng.choice(base[: rng.randint(1, 25)]) for _ in range(rng.randint(0, 30))]
        docs.append((i, " 3".join(spoil(w) if rng.random() < 0.15 else w.upper() if rng.random() < 0.1 else w for w in words)))
    docs += [(150, None), (150, ""), (None, base[0] + " " + base[0])]
    found = {r.word: tuple(r) for r in reduced_alphabet.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        assert found.pop(w) == (w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    assert not found and any(form.values())


@pytest.mark.parametrize("full", [False, True])
def test_reduced_neighbourhoods_are_whole(full):
    """Words one edit apart meet, on one side at least, in a key of one that is the other's own."""
    rng = random.Random(13)
    words = [[rng.randint(1, 3) for _ in range(rng.randint(3, 5))] for _ in range(200)]
    bounds = np.cumsum([0] + [len(w) for w in words])
    own, rows, keys = reduced_alphabet.neighbourhoods(np.array(sum(words, [])), bounds, 3, full)
    made = defaultdict(set)
    for r, k in zip(rows, keys):
        made[int(r)].add(int(k))
    for i, j in itertools.combinations(range(len(words)), 2):
        near = words[i] == words[j] or _one_edit(words[i], words[j])
        both = (int(own[j]) in made[i], int(own[i]) in made[j])
        assert (all(both) if full else any(both)) == near


def test_variants_of_odd_tables(spark, odd, none):
    assert reduced_alphabet.variants(none).collect() == []
    assert all(r.n >= 2 for r in reduced_alphabet.variants(odd).collect())
    with pytest.raises(ValueError):
        reduced_alphabet.variants(odd, ratio=1)


# op13


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def _components(sets):
    """The least index reachable from each set by links."""
    part = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            low, high = sorted((part[i], part[j]))
            part = [low if x == high else x for x in part]
    return part


def _crowd(rng, copies, changes, shared=0):
    """Copies of one text of 100 words, each with some words replaced: by words of its own, or by one of ``shared``."""
    base, texts = [f"w{i}" for i in range(100)], []
    for i in range(copies):
        words = list(base)
        for at in rng.sample(range(100), rng.choice(changes)):
            words[at] = f"s{rng.randrange(shared)}" if shared and rng.random() < 0.5 else f"o{i}x{at}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("changes, shared, block", [(range(7), 0, 3), (range(1, 7), 2, 32)])
def test_jaccard_components_of_a_crowd(spark, changes, shared, block):
    rng = random.Random(21)
    texts = _crowd(rng, 90, changes, shared) + [" ".join(x.split()[: rng.randint(60, 100)]) for x in _crowd(rng, 50, changes, shared)]
    texts += [" ".join(f"w{i}" for i in range(100, 100 + rng.randint(1, 60))) + " " + x for x in _crowd(rng, 20, changes, shared)]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.id: r.component_id for r in token_groups.jaccard_components(frame, block=block).collect()}
    want = _components([_shingles(text) for text in texts])
    assert [found[i] for i in range(len(texts))] == want


def test_jaccard_components_compare_few_pairs_of_a_crowd(spark, monkeypatch):
    compared, linked = [], token_groups.linked
    monkeypatch.setattr(token_groups, "linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    texts = _crowd(random.Random(22), 300, range(7))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert token_groups.jaccard_components(frame).count() == 300
    assert sum(compared) <= 4 * 300  # of 44,850 pairs


@pytest.mark.parametrize("block", [1, 3, 32])
def test_jaccard_components_match_brute_force(spark, block):
    rng = random.Random(14)
    texts = [_text(rng, rng.randint(1, 80)) for _ in range(12)]
    for _ in range(110):  # chains of small changes
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 1)
        texts.append(" \n".join(words) if words else rng.choice(WORDS))
    docs = list(enumerate(texts)) + [(200, None), (201, " "), (202, texts[0].upper()), (7, texts[3]), (None, texts[5]), (None, "")]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = token_groups.jaccard_components(frame, block=block).collect()
    sets = [(key, _shingles(text)) for key, text in docs]
    part = list(range(len(sets)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            part[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    want = [(key, len(s), least.get(root(i)) if s else key) for i, (key, s) in enumerate(sets)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_jaccard_components_of_odd_tables(spark, odd, none):
    assert token_groups.jaccard_components(none).collect() == []
    assert len(token_groups.jaccard_components(odd).collect()) == odd.count()
