"""Properties that decide whether a job holds at scale."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from islets import connected_components, run_components
from islets.operators.lookup import Hubs, lookup
from islets.plans.adjacency import bucket_count, bucketed_adjacency
from islets.plans.algorithms import _edge_degrees, sgc
from islets.plans.graph import load_graph
from islets.plans.rounds import Rounds
from islets.plans.workspace import Workspace, checkpoint_root
from islets.sources.edges import distinct_edges

SF_DIR = "/root/testdata/sf0.001"
PACKAGE = pathlib.Path(registered.__file__).parent / "islets"
STEPS = [
    name
    for name in registered.library_queries()
    if not name.startswith(("cc_", "write_", "read_", "run_", "step_", "component", "max_"))
    and name not in ("propagate", "size_distribution", "largest_component", "largest_component_edges")
]


def test_source_has_no_driver_side_data_work():
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".rdd", "toPandas", ".collect()", "applyInPandas", "udf("):
            assert word not in text, f"{word} in {path}"


@pytest.mark.parametrize("name", STEPS)
def test_plans_have_no_products_and_no_python(spark, name):
    frame = registered.library_queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "Python", "Window"):
        assert word not in plan


def test_scans_read_two_columns(spark):
    frame = distinct_edges(registered.order_part(spark, SF_DIR))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == {"l_orderkey:bigint,l_partkey:bigint"}
    assert "PushedFilters: [IsNotNull" in plan


class Session:
    """As much of a session as the choice of the folder looks at."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master
        self.own = None

    def setCheckpointDir(self, folder):
        self.own = folder

    def getCheckpointDir(self):
        return self.own


def test_tables_go_to_the_shared_folder_of_the_session(spark):
    run = run_components(registered.cust_order(spark, SF_DIR), "alternating")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert run.work.folder.startswith(f"{shared}/alternating-")
    assert run.labels.count() == 1650


def test_choice_of_the_folder():
    assert checkpoint_root(Session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session(None, "yarn"))
    session = Session(None, "local[2]")
    assert checkpoint_root(session) == session.own
    assert checkpoint_root(session) == session.own


def test_tables_of_former_rounds_are_dropped(spark):
    run = run_components(registered.event_user(spark, SF_DIR), "ccmr")
    folder = pathlib.Path(run.work.folder.removeprefix("file:"))
    left = sorted(path.name.split("-")[1] for path in folder.iterdir())
    assert run.rounds > 1 and left == ["ccmr", "edges"]


def test_plan_does_not_grow_with_rounds(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    run = run_components(path, "alternating")
    assert run.rounds > 5
    assert run.labels._jdf.queryExecution().executedPlan().toString().count("Scan") <= 4


def test_save_counts_what_it_writes(spark):
    frame = spark.range(10).withColumn("odd", F.col("id") % 2 == 1)
    table = Workspace(spark, "t").save(frame, "t", drop=("odd",), odd=F.count_if("odd"))
    assert (table.rows, table.counts["odd"], table.frame.columns) == (10, 5, ["id"])
    nothing = Workspace(spark, "t").save(frame.where("id > 99"), "t", odd=F.count_if("odd"))
    assert (nothing.rows, nothing.counts["odd"], nothing.frame.count()) == (0, 0, 0)


def test_one_vertex_with_most_edges(spark):
    star = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(-7)).otherwise(F.col("id")).alias("src"),
        (F.col("id") + 1).alias("dst"),
    )
    plain = connected_components(star, "tree_pruning_opt")
    split = connected_components(star, "tree_pruning_opt", hub_rows=1000)
    assert plain.exceptAll(split).count() == 0
    assert split.count() == plain.count()


@pytest.mark.parametrize("algorithm", ["alternating", "tree_pruning_opt", "hash_to_min"])
def test_steps_are_the_same_at_every_size(spark, algorithm):
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(40, 60)], "src long, dst long")
    runs = [
        run_components(edges, algorithm, **options)
        for options in ({}, {"hub_rows": 10}, {"hub_rows": 1000}, {"collect_stats": True})
    ]
    assert len({(run.rounds, tuple(record.name for record in run.steps)) for run in runs}) == 1


def _chain(spark, n):
    return spark.range(n).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))


def _adjacency(spark, hub_rows):
    run = Rounds(spark, "adjacency", hub_rows=hub_rows)
    edges = _chain(spark, 300).union(spark.range(2, 200).select("id", F.lit(0).cast("long"))).toDF("src", "dst")
    graph = load_graph(run, edges, None, "src", "dst")
    hubs = run.hubs(2 * graph.links)
    adjacency = bucketed_adjacency(run, graph.symmetric(), hubs, _edge_degrees(run, graph, hubs))
    labels = run.save("start", graph.linked_vertices().select("id", F.col("id").alias("label")), buckets=("id", bucket_count(run)))
    return run, graph, adjacency, labels


@pytest.mark.parametrize("hub_rows", [100, 4_000_000])
def test_rounds_shuffle_no_edges(spark, hub_rows):
    run, graph, adjacency, labels = _adjacency(spark, hub_rows)
    assert (adjacency.hub_edges is not None) == (hub_rows == 100)
    if adjacency.hub_edges is not None:
        assert adjacency.hub_edges.rows > 100
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        heard = adjacency.heard(labels.frame)
        plan = heard._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, heard.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning" not in plan and "Sort " not in plan
    assert found == sorted(map(tuple, graph.symmetric().select("id", F.col("nbr").alias("label")).collect()))


def test_bucketed_tables_leave_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    found = connected_components(_chain(spark, 20), "hash_min")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert found.where("component <> 0").count() == 0 and found.count() == 21


def test_hash_min_of_string_ids(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "src string, dst string")
    found = connected_components(edges, "hash_min", hub_rows=1)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_hooks_run_on_fewer_edges_each_time(spark):
    run = Rounds(spark, "sgc")
    graph = load_graph(run, registered.event_user(spark, SF_DIR), None, "src", "dst")
    sizes, record = [graph.links], run.record
    run.record = lambda name, table, messages: (sizes.append(table.rows) if name == "contract_edges" else None, record(name, table, messages))
    sgc(run, graph)
    assert len(sizes) > 3 and sizes == sorted(sizes, reverse=True) and sizes[-1] == 0


def test_hubs_are_looked_for_before_a_step_is_split(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("nbr"))
    run = Rounds(spark, "hubs", hub_rows=500)
    assert run.hubs(3000, rows, "id") is None
    assert run.hubs(3000, rows, "id", "nbr").limit == 500
    assert run.hubs(3000).limit == 500


def test_keys_are_counted_one_by_one_only_if_there_may_be_a_hub(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("nbr"))
    table = spark.range(3000).select("id", F.col("id").alias("nbr"), F.col("id").alias("m"))
    kept = []
    hubs = Hubs(500, lambda frame: (kept.append(frame), frame)[1])
    assert lookup(rows, table.select("id", "m"), "id", hubs).count() == 3000 and not kept
    assert lookup(rows, table.select("nbr", "m"), "nbr", hubs).count() == 3000 and len(kept) == 1


@pytest.mark.parametrize("name", ["small_star", "prune_links", "prune_links_oblivious", "split_hubs", "split_hub_trees"])
def test_steps_read_their_input_from_where_it_was_written_once(spark, name):
    files = registered.library_queries()[name](spark, SF_DIR).inputFiles()
    assert files and not any("lineitem" in file for file in files)
