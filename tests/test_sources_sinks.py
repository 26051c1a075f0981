"""Reading edges, projecting memberships, and writing results."""

import pytest

from graphs import EXAMPLE
from islets import connected_components, run_components
from islets.reports.components import (
    component_counts,
    component_sizes,
    degree_stats,
    largest_component,
    largest_component_edges,
    max_component_size,
    size_distribution,
)
from islets.reports.runs import run_summary, step_activity, step_messages, step_times
from islets.sinks.tables import (
    write_distribution,
    write_edges,
    write_labels,
    write_largest_component,
    write_stats,
)
from islets.sources.edges import (
    distinct_edges,
    edges_from,
    graph_counts,
    parse_edge_lines,
    read_edge_list,
    symmetrize,
)
from islets.sources.membership import (
    co_occurrence_degrees,
    co_occurrence_edges,
    membership_counts,
    read_membership,
)


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def lines(spark, path):
    return sorted(row["value"] for row in spark.read.text(str(path)).collect())


@pytest.fixture
def example(spark):
    return spark.createDataFrame(EXAMPLE, "src long, dst long")


def test_bad_lines_are_dropped(spark, tmp_path):
    text = "1\t2\n7\na\tb\n 3\t4\n5\t6\t0.9\n\n9223372036854775808\t1\n1.5\t2\n+8\t-9\n3\t\n"
    (tmp_path / "edges").write_text(text)
    assert rows(read_edge_list(spark, str(tmp_path / "edges"), r"\t")) == [(1, 2), (5, 6), (8, -9)]


@pytest.mark.parametrize("sep, line", [("space", "1 2"), (",", "1,2"), ("[|]", "1|2"), (r"\s*;\s*", "1 ; 2")])
def test_separators_are_patterns(spark, sep, line):
    assert rows(parse_edge_lines(spark.createDataFrame([(line,)], "value string"), sep)) == [(1, 2)]


def test_edge_forms(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (4, None)], "a long, b long")
    edges = edges_from(edges, "a", "b")
    assert len(rows(symmetrize(edges))) == 8
    assert rows(distinct_edges(edges)) == [(1, 2), (2, 1), (3, 3)]
    assert rows(graph_counts(edges)) == [(4, 3)]
    assert rows(graph_counts(edges.where("src > 99"))) == [(0, 0)]
    assert rows(degree_stats(distinct_edges(edges))) == [(3, 3, 1.0, 1)]


def test_membership(spark, tmp_path):
    (tmp_path / "members").write_text("1,a\n2,a\n3,a\n4,b\n5,b\n6,c\nx,a\n7\n")
    members = read_membership(spark, str(tmp_path / "members"))
    assert rows(co_occurrence_edges(members)) == [(1, 2), (1, 3), (4, 5)]
    assert rows(co_occurrence_degrees(members)) == [(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)]
    assert rows(membership_counts(members)) == [(6, 5)]
    labels = connected_components(co_occurrence_edges(members))
    assert rows(labels) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_reports(spark, example):
    labels = connected_components(example)
    sizes = component_sizes(labels)
    assert rows(sizes) == [(1, 6), (7, 2)]
    assert rows(component_counts(sizes)) == [(2, 2)]
    assert rows(max_component_size(sizes)) == [(6,)]
    assert rows(size_distribution(sizes)) == [(2, 1), (6, 1)]
    assert rows(largest_component(sizes)) == [(1, 6)]
    inside = [edge for edge in EXAMPLE if edge[0] < 7]
    both = sorted(inside + [(b, a) for a, b in inside], key=repr)
    assert rows(largest_component_edges(example, labels)) == both


def test_ties_go_to_the_smallest_label(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, component long")
    assert rows(largest_component(component_sizes(labels))) == [(1, 2)]


def test_text_sinks(spark, example, tmp_path):
    run = run_components(example, "alternating", dataset="example", collect_stats=True)
    write_labels(run.labels, str(tmp_path / "labels"))
    assert lines(spark, tmp_path / "labels") == [
        "1 1", "2 1", "3 1", "4 1", "5 1", "6 1", "7 7", "8 7",
    ]
    write_edges(example, str(tmp_path / "edges"))
    assert rows(read_edge_list(spark, str(tmp_path / "edges"))) == EXAMPLE
    write_largest_component(example, run.labels, str(tmp_path / "largest"))
    assert len(lines(spark, tmp_path / "largest")) == 10
    write_distribution(run.labels, str(tmp_path / "distribution"))
    write_distribution(run.labels, str(tmp_path / "distribution"))
    assert lines(spark, tmp_path / "distribution") == ["2,1", "2,1", "6,1", "6,1"]
    write_stats(run_summary(run, "x"), str(tmp_path / "stats"))
    (line,) = lines(spark, tmp_path / "stats")
    assert line.startswith("alternating,example,") and line.endswith(",2,2,6,x")
    write_labels(run.labels, str(tmp_path / "parquet"), format="parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 8


def test_run_reports(spark, example):
    run = run_components(example, "hash_min", dataset="example", collect_stats=True)
    activity = rows(step_activity(run))
    assert activity[0] == ("example", 0, 8, 100.0, "hash_min", 12.0, 1.5, 2)
    assert [row[1] for row in activity] == list(range(len(run.steps)))
    assert all(row[4] == row[3] * 2 for row in rows(step_messages(run)))
    assert len(rows(step_times(run))) == len(run.steps)
    summary = run_summary(run).first().asDict()
    assert (summary["ccNumber"], summary["ccMaxSize"]) == (2, 6)
    assert summary["reduceInputMessageNumber"] == sum(row[3] for row in rows(step_messages(run)))


def test_pruning_shrinks_the_active_graph(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(32)], "src long, dst long")
    run = run_components(path, "tree_pruning_opt", dataset="path", collect_stats=True)
    active = [s.receivers for s in run.steps if s.name == "prune"]
    assert active == sorted(active, reverse=True) and active[-1] < active[0]


def test_message_reports_need_statistics(spark, example):
    run = run_components(example)
    with pytest.raises(ValueError, match="collect_stats"):
        step_messages(run)
    assert run_summary(run).first()["reduceInputMessageNumber"] == 0


def test_lines_that_end_after_the_comma_are_no_memberships(spark):
    from islets.sources.membership import parse_membership_lines

    lines = spark.createDataFrame([("5,",), ("6,",), ("7,a",), ("8,,x",), ("9",), ("b,a",), ("10,,,",)], "value string")
    assert sorted(map(tuple, parse_membership_lines(lines).collect())) == [(7, "a"), (8, "")]


def test_null_ends_are_no_edges(spark):
    edges = spark.createDataFrame([(3, None), (1, 2), (None, None)], "src long, dst long")
    assert sorted(map(tuple, distinct_edges(edges).collect())) == [(1, 2), (2, 1)]
    assert tuple(graph_counts(edges).first()) == (1, 2)


def test_wider_vertices_are_not_narrowed(spark):
    from islets import connected_components

    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    found = connected_components(edges, vertices=spark.createDataFrame([(1 << 40,)], "id long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (1 << 40, 1 << 40)]


def test_missing_metrics_do_not_empty_a_table(spark, monkeypatch):
    import pytest
    from pyspark.sql import Observation

    from islets.plans.workspace import Workspace

    def missing(self):
        raise RuntimeError("assertion failed")

    monkeypatch.setattr(Observation, "get", property(missing))
    with pytest.raises(RuntimeError):
        Workspace(spark, "metrics").save(spark.range(3), "rows")
    assert Workspace(spark, "metrics").save(spark.range(0), "rows").rows == 0
