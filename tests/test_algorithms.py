"""All algorithms against union-find, and the behaviours that are easy to get wrong."""

import pytest

from graphs import EXAMPLE, NAMED, components, many_graphs, powerlaw_graph
from islets import ALGORITHMS, connected_components, run_components
from islets.plans.rounds import NotConverged

MANY = many_graphs()


def frame(spark, edges, schema="src long, dst long"):
    return spark.createDataFrame(edges, schema)


def as_dict(labels):
    rows = labels.collect()
    found = {row["id"]: row["component"] for row in rows}
    assert len(found) == len(rows), "a vertex has two labels"
    return found


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_many_graphs(spark, algorithm):
    labels = connected_components(frame(spark, MANY), algorithm)
    assert as_dict(labels) == components(MANY)


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_hub_split_gives_the_same(spark, algorithm):
    edges = powerlaw_graph()
    labels = connected_components(frame(spark, edges), algorithm, hub_rows=15)
    assert as_dict(labels) == components(edges)


@pytest.mark.parametrize(
    "options",
    [
        {"oblivious_seed": True},
        {"oblivious_seed": {0, 1, 4}},
        {"edge_pruning": False, "oblivious_seed": True},
    ],
    ids=str,
)
def test_tree_pruning_options(spark, options):
    labels = connected_components(frame(spark, MANY), "tree_pruning_opt", **options)
    assert as_dict(labels) == components(MANY)


@pytest.mark.parametrize("salts", [None, 3])
def test_virtual_vertices_stay_apart_from_real_ones(spark, salts):
    """Vertex 6 has two neighbours; virtual ids derived by arithmetic would be 7 and 8."""
    options = {"hub_degree": 1, "salts": salts}
    labels = connected_components(frame(spark, EXAMPLE), "alternating_hub_split", **options)
    assert as_dict(labels) == components(EXAMPLE)


@pytest.mark.parametrize("options", [{}, {"hub_degree": 4}, {"hub_degree": 4, "hub_rows": 15}], ids=str)
def test_hub_trees_give_the_same(spark, options):
    edges = powerlaw_graph()
    run = run_components(frame(spark, edges), "alternating_hub_split", collect_stats=True, **options)
    assert as_dict(run.labels) == components(edges)
    assert [r.name for r in run.steps][1:3] == ["degrees", "split_hubs"]


def test_rounds_on_hub_trees_run_on_fewer_links_each_time(spark):
    """Stars kept whole would travel in each round: never less than one link for each vertex but one."""
    edges = powerlaw_graph()
    run = run_components(frame(spark, edges), "alternating_hub_split", hub_degree=4, collect_stats=True)
    links = [r.active_edges for r in run.steps if r.name == "large_star"]
    assert len(links) > 2 and links == sorted(links, reverse=True) and links[-1] < links[0] / 4
    assert as_dict(run.labels) == components(edges)


def test_nothing_is_written_when_nothing_splits(spark):
    run = run_components(frame(spark, EXAMPLE), "alternating_hub_split", hub_degree=100)
    assert as_dict(run.labels) == components(EXAMPLE)
    assert "split_hubs" not in [r.name for r in run.steps]


@pytest.mark.parametrize("algorithm", ["ccf", "ccmr", "tree_pruning_opt"])
def test_largest_and_smallest_longs(spark, algorithm):
    labels = connected_components(frame(spark, NAMED["extremes"]), algorithm)
    assert as_dict(labels) == components(NAMED["extremes"])


def test_a_single_vertex(spark):
    assert as_dict(connected_components(frame(spark, NAMED["singleton"]), "ccf")) == {5: 5}


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_empty(spark, algorithm):
    labels = connected_components(frame(spark, []), algorithm)
    assert labels.columns == ["id", "component"]
    assert labels.collect() == []


def test_incomplete_rows_and_isolated_vertices(spark):
    edges = frame(spark, [(1, 2), (3, None), (None, 4), (5, 5)])
    vertices = frame(spark, [(2,), (9,), (9,), (None,)], "v int")
    labels = connected_components(edges, vertices=vertices, collect_stats=True)
    assert as_dict(labels) == {1: 1, 2: 1, 5: 5, 9: 9}


def test_other_key_types_and_names(spark):
    edges = frame(spark, [("b", "a"), ("c", "b"), ("x", "y")], "one string, two string")
    labels = connected_components(edges, src="one", dst="two")
    assert as_dict(labels) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


PATH = [(i, i + 1) for i in range(64)]


@pytest.mark.parametrize(
    "algorithm, rounds",
    [("hash_to_min", 8), ("ccf", 8), ("ccmr", 8), ("alternating", 7)],
)
def test_rounds_on_a_path_are_logarithmic(spark, algorithm, rounds):
    run = run_components(frame(spark, PATH), algorithm)
    assert as_dict(run.labels) == dict.fromkeys(range(65), 0)
    assert run.rounds <= rounds


def test_tree_pruning_rounds_on_a_path(spark):
    run = run_components(frame(spark, PATH), "tree_pruning_opt")
    assert as_dict(run.labels) == dict.fromkeys(range(65), 0)
    assert sum(step.name == "min_selection" for step in run.steps) <= 9


def test_stars_need_one_round(spark):
    for edges in (NAMED["star_min"], NAMED["star_max"]):
        run = run_components(frame(spark, edges), "alternating")
        assert run.rounds <= 2


def test_guard_against_endless_loops(spark):
    with pytest.raises(NotConverged):
        run_components(frame(spark, PATH), "hash_min", max_rounds=3)


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError, match="alternating"):
        connected_components(frame(spark, EXAMPLE), "fastest")


def test_labels_move_along_labels(spark):
    run = run_components(frame(spark, PATH), "hash_min")
    assert as_dict(run.labels) == dict.fromkeys(range(65), 0)
    assert run.rounds <= 8  # 64 with one hop a round


def test_rounds_on_hub_trees_run_on_longs(spark):
    edges = [("hub", f"v{i:02}") for i in range(30)] + [("a", "v07"), ("x", "y")]
    run = run_components(frame(spark, edges, "src string, dst string"), "alternating_hub_split", hub_degree=4)
    assert as_dict(run.labels) == {v: "x" if v in "xy" else "a" for edge in edges for v in edge}
    assert "number_vertices" in [step.name for step in run.steps]
