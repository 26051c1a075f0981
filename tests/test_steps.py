"""Single steps on small graphs, row by row."""

from collections import Counter

import pytest

from graphs import EXAMPLE, components
from islets.operators.ccf import ccf_iterate
from islets.operators.ccmr import ccmr_round
from islets.operators.hooking import (
    canonical_label,
    forest_init,
    min_neighbour_parent,
    star_detection,
    unconditional_star_hook,
)
from islets.operators.hub_trees import (
    degree_histogram,
    degree_limit,
    numbered_links,
    split_hub_trees,
    vertex_numbers,
)
from islets.operators.lookup import Hubs
from islets.operators.min_label import hash_min_round
from islets.operators.stars import as_vertex_pairs, drop_virtual, labels_changed, large_star, small_star
from islets.operators.stars import follow_links, local_maxima, split_hubs, without_maxima
from islets.operators.tree_pruning import (
    merge_forest,
    min_selection,
    pointer_jump,
    prepare_propagation,
    prune_links,
    prune_tree_edges,
)
from islets.sources.edges import distinct_edges

PAIR = "id long, nbr long"
PARENT = "id long, parent long"


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def symmetric(spark, edges):
    return distinct_edges(spark.createDataFrame(edges, "src long, dst long"))


def test_large_star_on_the_example(spark):
    expected = [(1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (5, 1), (5, 3), (6, 2), (6, 4), (7, 7), (8, 7)]
    assert rows(large_star(symmetric(spark, EXAMPLE))) == expected


def test_small_star_orients_its_input(spark):
    edges = spark.createDataFrame([(1, 3), (3, 2), (3, 1)], PAIR)
    assert rows(small_star(edges)) == [(1, 1), (2, 1), (3, 1)]
    assert rows(small_star(spark.createDataFrame([(3, 1), (3, 2)], PAIR), oriented=True)) == [
        (1, 1),
        (2, 1),
        (3, 1),
    ]


def test_min_selection_and_pruning(spark):
    live = symmetric(spark, [(1, 2), (2, 3)])
    heard = min_selection(live)
    # 2 tells both neighbours of 1, 3 tells 2 of 2, and 1 stays silent
    assert rows(heard) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert rows(min_selection(live, edge_pruning=False)) == rows(heard)
    assert rows(prune_tree_edges(heard)) == [(3, 1)]
    assert rows(prune_links(heard)) == [(1, 1), (1, 2), (2, 1)]
    assert rows(prune_links(heard, oblivious_seed=True)) == [(1, 1), (2, 1)]


def test_vertices_without_neighbours_fall_silent(spark):
    assert rows(min_selection(spark.createDataFrame([(4, 4)], PAIR))) == []


def test_forest(spark):
    roots = spark.createDataFrame([(1, None), (2, None), (3, None)], PARENT)
    forest = merge_forest(roots, spark.createDataFrame([(3, 2)], PARENT))
    assert rows(forest) == [(1, None), (2, None), (3, 2)]
    tree = spark.createDataFrame([(3, 2), (2, 1), (5, 4)], PARENT)
    assert rows(prepare_propagation(tree)) == [(1, 1), (2, 1), (3, 2), (4, 4), (5, 4)]


def test_pointer_jump(spark):
    chain = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], PARENT)
    assert rows(pointer_jump(chain)) == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert rows(pointer_jump(chain, with_old=True))[3] == (4, 2, 3)


def test_hash_min_round_sends_only_changed_labels(spark):
    live = symmetric(spark, [(1, 2), (2, 3)])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, label long")
    assert rows(hash_min_round(labels, live)) == [(1, 1), (2, 1), (3, 1)]
    marked = spark.createDataFrame(
        [(1, 1, True), (2, 1, False), (3, 2, True)], "id long, label long, changed boolean"
    )
    assert rows(hash_min_round(marked, live)) == [(1, 1), (2, 1), (3, 2)]


def test_ccf_keeps_copies(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2)], PAIR)
    assert rows(ccf_iterate(edges)) == [(2, 1), (3, 1)]
    edges = spark.createDataFrame([(3, 1), (4, 1), (3, 2), (4, 2)], PAIR)
    assert rows(ccf_iterate(edges)) == [(2, 1), (2, 1), (3, 1), (4, 1)]


def test_ccmr_round(spark):
    assert rows(ccmr_round(symmetric(spark, [(1, 2), (2, 3)]))) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_split_hubs(spark):
    star = symmetric(spark, [(9, i) for i in range(1, 6)])
    split = split_hubs(star, degree=4, salts=2)
    found = rows(split.where("id = 9"))
    assert found == [
        (9, 0, 9, 1),
        (9, 0, 9, 2),
        (9, 1, 2, 0),
        (9, 1, 4, 0),
        (9, 2, 1, 0),
        (9, 2, 3, 0),
        (9, 2, 5, 0),
    ]
    assert rows(split.where("id <> 9")) == [(i, 0, 9, 0) for i in range(1, 6)]


def test_a_hub_gets_as_many_virtual_vertices_as_it_needs(spark):
    star = symmetric(spark, [(1000, i) for i in range(400)])
    split = split_hubs(star, degree=50)
    sizes = split.where("id = 1000 and salt > 0").groupBy("salt").count().collect()
    assert len(sizes) == 8
    assert max(row["count"] for row in sizes) < 100


@pytest.mark.parametrize("hubs", [None, Hubs(50)])
@pytest.mark.parametrize("degree", [4, 5, 20])
def test_no_vertex_of_the_trees_is_above_the_limit(spark, degree, hubs):
    """Two hubs that are neighbours of each other and of many; trees of several levels."""
    edges = [(1000, i) for i in range(300)] + [(2000, i) for i in range(100, 500)] + [(1000, 2000), (1, 2)]
    links = split_hub_trees(symmetric(spark, edges), degree=degree, hubs=hubs).collect()
    assert len(links) == len(set(links))
    degrees = Counter()
    for a, b in links:
        assert a > b
        degrees.update([a, b])
    assert max(degrees.values()) <= degree
    assert max(v.level for v in degrees) > (1 if degree < 20 else 0)
    between = [(a, b) for a, b in links if a.id != b.id]
    assert sorted((a.id, b.id) for a, b in between) == sorted((max(e), min(e)) for e in edges)
    # virtual vertices have one link up each, and all lead to their real vertex
    virtual = {v for v in degrees if v.salt}
    assert len(links) - len(between) == len(virtual)
    names = {v: i for i, v in enumerate(sorted(degrees))}
    inner = [(names[a], names[b]) for a, b in links if a.id == b.id]
    first = {names[v]: names[min(w for w in degrees if w.id == v.id)] for v in virtual}
    found = components(inner)
    assert all(found[v] == first[v] for v in first)
    assert all(v.salt == 0 for v in degrees if v.level == 0)


def test_trees_of_an_empty_graph_and_a_limit_without_room(spark):
    none = symmetric(spark, [(1, 2)]).limit(0)
    assert split_hub_trees(none, degree=4).collect() == []
    assert degree_limit(degree_histogram(none.groupBy("id").count().withColumnRenamed("count", "n"))).first()[0] == 4
    with pytest.raises(ValueError):
        split_hub_trees(none, degree=3)


def test_degree_limit(spark):
    """One hub of 1,024 links beside 10,000 vertices of one: 2 x 1,024 <= 0.01 x 11,024 x (32 - 1)."""
    degrees = spark.range(10_001).selectExpr("id", "if(id = 0, 1024L, 1L) AS n")
    assert degree_limit(degree_histogram(degrees)).first()["degree_limit"] == 32


@pytest.mark.parametrize("hubs", [None, Hubs(1)])
def test_local_maxima_are_set_aside_and_led_to_the_centres(spark, hubs):
    links = spark.createDataFrame([(2, 1), (4, 3), (5, 2), (5, 3), (6, 5), (6, 1), (6, 2), (9, 8)], "id long, nbr long")
    maxima = local_maxima(links)
    assert rows(maxima) == [(4, 3), (6, 1), (9, 8)]
    left = without_maxima(links, maxima, hubs=hubs)
    assert rows(left) == [(2, 1), (2, 1), (5, 1), (5, 2), (5, 3)]
    stars = spark.createDataFrame([(2, 1), (3, 1), (5, 1)], "id long, nbr long")
    assert rows(follow_links(maxima, stars, hubs=hubs)) == [(4, 1), (6, 1), (9, 8)]


@pytest.mark.parametrize("hubs", [None, Hubs(1)])
def test_links_between_numbers_are_those_between_the_vertices(spark, hubs):
    links = split_hub_trees(symmetric(spark, [(0, i) for i in range(1, 30)] + [(1, 2)]), degree=4, hubs=hubs)
    numbers = {row.vertex: row.number for row in vertex_numbers(links).collect()}
    assert len(set(numbers.values())) == len(numbers)
    table = spark.createDataFrame(list(numbers.items()), "vertex struct<id: long, level: int, salt: long>, number long")
    ends = [(numbers[a], numbers[b]) for a, b in links.collect()]
    assert rows(numbered_links(links, table, hubs=hubs)) == sorted(((max(e), min(e)) for e in ends), key=repr)


def test_drop_virtual(spark):
    split = spark.createDataFrame(
        [(2, 0, 1, 0), (2, 1, 2, 0)], "id long, salt int, nbr long, nbr_salt int"
    )
    labels = as_vertex_pairs(split).withColumnRenamed("nbr", "component")
    assert rows(drop_virtual(labels)) == [(2, 1)]


def test_labels_changed(spark):
    schema = "id long, component long"
    before = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], schema)
    after = spark.createDataFrame([(1, 1), (2, 1), (4, 4)], schema)
    assert rows(labels_changed(before, before)) == [(0,)]
    assert rows(labels_changed(before, after)) == [(3,)]


def test_hooking(spark):
    live = symmetric(spark, [(1, 5), (2, 5), (2, 6), (3, 6)])
    parents = forest_init(live)
    assert rows(parents) == [(1, 1), (2, 2), (3, 6), (5, 1), (6, 2)]
    stars = star_detection(parents)
    assert rows(stars) == [
        (1, 1, True),
        (2, 2, False),
        (3, 6, False),
        (5, 1, True),
        (6, 2, False),
    ]
    candidates = min_neighbour_parent(live, parents, unconditional=True)
    assert rows(candidates) == [(1, 2), (2, 1), (6, 2)]
    assert rows(unconditional_star_hook(stars, candidates))[0] == (1, 2)
    assert rows(canonical_label(spark.createDataFrame([(4, 9), (9, 9), (2, 2)], PARENT))) == [
        (2, 2),
        (4, 4),
        (9, 4),
    ]
