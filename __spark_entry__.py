"""Registered queries and the SQL that must give the same rows.

Graphs, each over whole tables (even and odd ids keep two domains apart):

* ``docs``        documents with equal text, linked to the first of them
* ``cust_order``  orders and their customers: many stars
* ``order_part``  orders and their parts: one giant component
* ``event_user``  events and users in one id space: few deep components
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islets import connected_components, run_components
from islets.operators.ccf import ccf_dedup, ccf_iterate
from islets.operators.ccmr import ccmr_round
from islets.operators.clusters import hash_to_min_round
from islets.operators.hooking import (
    canonical_label,
    conditional_star_hook,
    contract_edges,
    forest_init,
    min_neighbour_parent,
    star_detection,
    unconditional_star_hook,
)
from islets.operators.hub_trees import degree_histogram, degree_limit, split_hub_trees
from islets.operators.min_label import hash_min_round
from islets.operators.rows import both_directions, local_minimum
from islets.operators.stars import (
    as_vertex_pairs,
    drop_virtual,
    labels_changed,
    large_star,
    small_star,
    split_hubs,
    star_labels,
)
from islets.operators.tree_pruning import (
    merge_forest,
    min_selection,
    pointer_jump,
    prepare_propagation,
    prune_links,
    prune_tree_edges,
)
from islets.plans.algorithms import propagate
from islets.plans.rounds import Rounds
from islets.plans.workspace import Workspace
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
    parse_membership_lines,
)

try:  # the operators on text, and the pipeline made of them, may be left out
    import corpus_pipeline
    from islets.llm import registry as llm
except ImportError:
    corpus_pipeline = llm = None

HUB_DEGREE = 35
SALTS = 4


# --- graphs ---------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return co_occurrence_edges(
        documents.select(F.col("doc_id").alias("vertex"), F.md5("text").alias("arc"))
    )


def cust_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return edges_from(orders, F.col("o_orderkey") * 2, F.col("o_custkey") * 2 + 1)


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return edges_from(lineitem, F.col("l_orderkey") * 2, F.col("l_partkey") * 2 + 1)


def event_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_from(_table(spark, sf_dir, "events"), "event_id", "user_id")


def part_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: parts that share an order."""
    lineitem = _table(spark, sf_dir, "lineitem")
    return lineitem.select(F.col("l_partkey").alias("vertex"), F.col("l_orderkey").alias("arc"))


def _documents_run(spark: SparkSession, sf_dir: str, **options):
    ids = _table(spark, sf_dir, "documents").select("doc_id")
    edges = docs(spark, sf_dir)
    return run_components(edges, "alternating", vertices=ids, dataset="docs", **options)


def _linked(edges: DataFrame) -> DataFrame:
    """Symmetric distinct rows without self-loops, the input of the steps."""
    return distinct_edges(edges.where("src <> dst"))


def _once(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, larger end first."""
    return _linked(edges).where("id > nbr")


def _links(edges: DataFrame) -> tuple[Rounds, DataFrame, int]:
    """A run for single steps, each undirected edge once as written by it, and their number.

    Steps read their input several times, so it is written before, as between the rounds of a whole job.
    """
    run = Rounds(edges.sparkSession, "steps")
    table = run.work.save(_once(edges), "edges")
    return run, table.frame, table.rows


# --- queries --------------------------------------------------------------------------------------


def _whole_job(graph, algorithm: str, **options):
    return lambda spark, sf_dir: connected_components(graph(spark, sf_dir), algorithm, **options)


def _on(graph, step):
    return lambda spark, sf_dir: step(graph(spark, sf_dir))


def _on_labels(graph, report):
    return lambda spark, sf_dir: report(connected_components(graph(spark, sf_dir), "alternating"))


def _on_sizes(graph, report):
    return _on_labels(graph, lambda labels: report(component_sizes(labels)))


def _first_selection(edges: DataFrame, **options) -> tuple[Rounds, DataFrame]:
    run, once, rows = _links(edges)
    live = both_directions(once)
    return run, min_selection(live, hubs=run.hubs(2 * rows, live, "id"), **options)


def _first_heard(edges: DataFrame) -> DataFrame:
    run, heard = _first_selection(edges)
    return run.work.save(heard, "heard").frame


def _prune_links(edges: DataFrame, **options) -> DataFrame:
    run, heard = _first_selection(edges)
    table = run.work.save(heard, "heard")
    hubs = run.hubs(table.rows, table.frame, "id")
    return prune_links(table.frame, hubs=hubs, **options)


def _large_star(edges: DataFrame) -> tuple[Rounds, DataFrame]:
    run, once, rows = _links(edges)
    return run, large_star(once, hubs=run.hubs(rows, once, "nbr"))


def _small_star(edges: DataFrame) -> DataFrame:
    run, links = _large_star(edges)
    table = run.work.save(links, "large_star")
    return small_star(table.frame, hubs=run.hubs(table.rows, table.frame, "id"))


def _first_parents(edges: DataFrame) -> DataFrame:
    return local_minimum(_linked(edges)).select("id", F.col("m").alias("parent"))


def _merge_forest(edges: DataFrame) -> DataFrame:
    live = _linked(edges)
    roots = live.select("id").distinct().withColumn("parent", F.lit(None).cast("long"))
    return merge_forest(roots, prune_tree_edges(min_selection(live)))


def _propagate(edges: DataFrame) -> DataFrame:
    run = Rounds(edges.sparkSession, "propagate")
    forest = run.save("forest", _first_parents(edges))
    return propagate(run, forest).frame.select("id", F.col("parent").alias("component"))


def _hash_min_round(edges: DataFrame) -> DataFrame:
    live = _linked(edges)
    return hash_min_round(live.groupBy("id").agg(F.min("nbr").alias("label")), live)


def _contract_edges(edges: DataFrame) -> DataFrame:
    return contract_edges(_once(edges), _first_parents(edges))


def _hash_to_min_round(edges: DataFrame) -> DataFrame:
    live = _linked(edges)
    own = live.select("id", F.col("id").alias("member")).distinct()
    return hash_to_min_round(live.select("id", F.col("nbr").alias("member")).unionByName(own))


def _split_trees(edges: DataFrame) -> DataFrame:
    """Of each vertex: edges that it and its virtual ones carry, and how many of these are above the limit."""
    run, once, rows = _links(edges)
    live = both_directions(once)
    hubs = run.hubs(2 * rows, live, "id")
    links = both_directions(split_hub_trees(live, degree=4, hubs=hubs, keep=run.keep))
    per_vertex = links.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("nbr.id") != F.col("id.id")).alias("edges")
    )
    return per_vertex.groupBy(F.col("id.id").alias("id")).agg(
        F.sum("edges").alias("edges"), F.count_if(F.col("n") > 4).alias("above_limit")
    )


def _degree_limit(edges: DataFrame) -> DataFrame:
    degrees = _linked(edges).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return degree_limit(degree_histogram(degrees))


def _split(edges: DataFrame) -> DataFrame:
    run, once, rows = _links(edges)
    live = both_directions(once)
    return split_hubs(live, degree=HUB_DEGREE, salts=SALTS, hubs=run.hubs(2 * rows, live, "id"))


def _labels_changed(edges: DataFrame) -> DataFrame:
    after = small_star(large_star(_once(edges)))
    return labels_changed(star_labels(_linked(edges)), star_labels(after))


def _star_detection(edges: DataFrame) -> DataFrame:
    return star_detection(forest_init(_linked(edges)))


def _min_neighbour_parent(edges: DataFrame, unconditional: bool = False) -> DataFrame:
    live = _linked(edges)
    return min_neighbour_parent(live, forest_init(live), unconditional=unconditional)


def _star_hook(edges: DataFrame, unconditional: bool) -> DataFrame:
    live = _linked(edges)
    parents = forest_init(live)
    hook = unconditional_star_hook if unconditional else conditional_star_hook
    candidates = min_neighbour_parent(live, parents, unconditional=unconditional)
    return hook(star_detection(parents), candidates)


def _largest_component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cust_order(spark, sf_dir)
    return largest_component_edges(edges, connected_components(edges))


def _edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three fields, and the documents as lines that are no edges."""
    lineitem = _table(spark, sf_dir, "lineitem")
    lines = lineitem.select(
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_returnflag").alias("value")
    )
    texts = _table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    return lines.unionByName(texts)


def _membership_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return lineitem.select(F.concat_ws(",", "l_partkey", "l_orderkey").alias("value"))


def _read_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "edge-list").folder
    write_edges(order_part(spark, sf_dir), path)
    return read_edge_list(spark, path)


def _written(write, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = Workspace(spark, name).folder
        write(spark, sf_dir, path)
        return spark.read.text(path).select(F.col("value").alias("line"))

    return query


def _write_labels(spark, sf_dir, path):
    write_labels(_documents_run(spark, sf_dir).labels, path)


def _write_edges(spark, sf_dir, path):
    write_edges(order_part(spark, sf_dir), path)


def _write_distribution(spark, sf_dir, path):
    write_distribution(_documents_run(spark, sf_dir).labels, path)


def _write_largest_component(spark, sf_dir, path):
    edges = cust_order(spark, sf_dir)
    write_largest_component(edges, connected_components(edges), path)


def _write_stats(spark, sf_dir, path):
    run = _documents_run(spark, sf_dir, collect_stats=True)
    write_stats(step_messages(run), path)


SUMMARY_COLUMNS = (
    "algorithmName",
    "dataset",
    "reduceInputMessageNumber",
    "reduceInputSize",
    "ccNumber",
    "ccNumberNoIsolatedVertices",
    "ccMaxSize",
    "customColumn",
)


def _run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that do not depend on the clock."""
    run = _documents_run(spark, sf_dir, collect_stats=True)
    return run_summary(run, custom_column="all documents").select(*SUMMARY_COLUMNS)


def _step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps were timed; the times themselves differ from run to run."""
    times = step_times(_documents_run(spark, sf_dir))
    return times.select("dataset", "algorithm", "step", (F.col("time") >= 0).alias("timed"))


def _step_report(report, **options):
    return lambda spark, sf_dir: report(_documents_run(spark, sf_dir, **options))


def entry(spark: SparkSession) -> DataFrame:
    """The canonical id of each document: the least id among documents of the same text."""
    return _documents_run(spark, "/root/testdata/sf0.001").labels


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries for the graph operators."""
    return {
        # whole jobs
        "cc_documents": lambda spark, sf_dir: _documents_run(spark, sf_dir).labels,
        "cc_cust_order": _whole_job(cust_order, "tree_pruning_opt"),
        "cc_tree_pruning": _whole_job(event_user, "tree_pruning"),
        "cc_tree_pruning_opt": _whole_job(event_user, "tree_pruning_opt", oblivious_seed={0}),
        "cc_tree_pruning_oblivious": _whole_job(
            order_part, "tree_pruning_opt", oblivious_seed=True
        ),
        "cc_tree_pruning_balanced": _whole_job(
            event_user, "tree_pruning_opt", oblivious_seed={0, 1, 4, 8, 16}
        ),
        "cc_hash_min": _whole_job(order_part, "hash_min"),
        "cc_hash_min_deep": _whole_job(event_user, "hash_min"),
        "cc_hash_min_hubs": _whole_job(order_part, "hash_min", hub_rows=HUB_DEGREE),
        "cc_sgc_hubs": _whole_job(order_part, "sgc", hub_rows=HUB_DEGREE),
        "contract_edges": _on(event_user, _contract_edges),
        "cc_hash_to_min": _whole_job(event_user, "hash_to_min"),
        "cc_ccf": _whole_job(event_user, "ccf"),
        "cc_ccmr": _whole_job(event_user, "ccmr"),
        "cc_alternating": _whole_job(event_user, "alternating"),
        "cc_alternating_hub_trees": _whole_job(order_part, "alternating_hub_split", hub_degree=4),
        "cc_alternating_hub_default": _whole_job(event_user, "alternating_hub_split"),
        "cc_alternating_hub_split": _whole_job(
            order_part, "alternating_hub_split", hub_degree=HUB_DEGREE
        ),
        "cc_sgc": _whole_job(event_user, "sgc"),
        # sources
        "parse_edge_lines": lambda spark, sf_dir: parse_edge_lines(
            _edge_lines(spark, sf_dir), "[|]"
        ),
        "read_edge_list": _read_edge_list,
        "parse_membership_lines": _on(_membership_lines, parse_membership_lines),
        "symmetrize": _on(order_part, symmetrize),
        "adjacency": _on(order_part, distinct_edges),
        "co_occurrence_star": _on(part_orders, co_occurrence_edges),
        "co_occurrence_degrees": _on(part_orders, co_occurrence_degrees),
        "membership_counts": _on(part_orders, membership_counts),
        "graph_counts": _on(event_user, graph_counts),
        # steps of tree pruning
        "min_selection": _on(order_part, lambda edges: _first_selection(edges)[1]),
        "min_selection_unpruned": _on(
            order_part, lambda edges: _first_selection(edges, edge_pruning=False)[1]
        ),
        "prune_links": _on(order_part, _prune_links),
        "prune_links_oblivious": _on(
            order_part, partial(_prune_links, oblivious_seed=True)
        ),
        "prune_tree_edges": _on(order_part, lambda edges: prune_tree_edges(_first_heard(edges))),
        "merge_forest": _on(order_part, _merge_forest),
        "prepare_propagation": _on(
            order_part, lambda edges: prepare_propagation(prune_tree_edges(_first_heard(edges)))
        ),
        "propagate": _on(event_user, _propagate),
        # steps of the other algorithms
        "hash_min_round": _on(event_user, _hash_min_round),
        "hash_to_min_round": _on(event_user, _hash_to_min_round),
        "ccf_iterate": _on(event_user, lambda edges: ccf_iterate(_once(edges))),
        "ccf_dedup": _on(event_user, lambda edges: ccf_dedup(ccf_iterate(_once(edges)))),
        "ccmr_round": _on(event_user, lambda edges: ccmr_round(_linked(edges))),
        "large_star": _on(order_part, lambda edges: _large_star(edges)[1]),
        "small_star": _on(order_part, _small_star),
        "split_hubs": _on(order_part, _split),
        "split_hub_trees": _on(order_part, _split_trees),
        "degree_limit": _on(event_user, _degree_limit),
        "drop_virtual": _on(
            order_part, lambda edges: drop_virtual(star_labels(as_vertex_pairs(_split(edges))))
        ),
        "labels_changed": _on(event_user, _labels_changed),
        "forest_init": _on(event_user, lambda edges: forest_init(_linked(edges))),
        "star_detection": _on(event_user, _star_detection),
        "min_neighbour_parent": _on(event_user, _min_neighbour_parent),
        "min_neighbour_parent_unconditional": _on(
            event_user, partial(_min_neighbour_parent, unconditional=True)
        ),
        "conditional_star_hook": _on(event_user, partial(_star_hook, unconditional=False)),
        "unconditional_star_hook": _on(event_user, partial(_star_hook, unconditional=True)),
        "pointer_jump": _on(event_user, lambda edges: pointer_jump(_first_parents(edges))),
        "canonical_label": _on(
            event_user, lambda edges: canonical_label(forest_init(_linked(edges)))
        ),
        # reports
        "degree_stats": _on(order_part, lambda edges: degree_stats(distinct_edges(edges))),
        "component_sizes": _on_labels(cust_order, component_sizes),
        "component_counts": lambda spark, sf_dir: component_counts(
            component_sizes(_documents_run(spark, sf_dir).labels)
        ),
        "max_component_size": _on_sizes(cust_order, max_component_size),
        "size_distribution": _on_sizes(cust_order, size_distribution),
        "largest_component": _on_sizes(cust_order, largest_component),
        "largest_component_edges": _largest_component_edges,
        "run_summary": _run_summary,
        "step_activity": _step_report(step_activity, collect_stats=True),
        "step_messages": _step_report(step_messages, collect_stats=True),
        "step_times": _step_times,
        # sinks, read back as lines
        "write_labels": _written(_write_labels, "labels"),
        "write_edges": _written(_write_edges, "edges"),
        "write_distribution": _written(_write_distribution, "distribution"),
        "write_largest_component": _written(_write_largest_component, "largest"),
        "write_stats": _written(_write_stats, "stats"),
    }


# --- oracle ---------------------------------------------------------------------------------------

DOCS = """
SELECT f.first AS src, d.doc_id AS dst
FROM documents d JOIN (SELECT md5(text) h, min(doc_id) first FROM documents GROUP BY 1) f
  ON md5(d.text) = f.h WHERE d.doc_id <> f.first"""
CUST_ORDER = "SELECT o_orderkey * 2 AS src, o_custkey * 2 + 1 AS dst FROM orders"
ORDER_PART = "SELECT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem"
EVENT_USER = "SELECT event_id AS src, user_id AS dst FROM events"
MEMBERS = "SELECT l_partkey AS vertex, l_orderkey AS arc FROM lineitem"


def _edges(graph: str) -> str:
    return f"""g AS ({graph}),
e AS MATERIALIZED (SELECT src s, dst t FROM g WHERE src <> dst
                   UNION SELECT dst, src FROM g WHERE src <> dst)"""


def _labels(graph: str) -> str:
    """Least id per component, one row per vertex kept while labels spread."""
    return f"""g AS ({graph}),
e AS MATERIALIZED (SELECT src s, dst t FROM g UNION SELECT dst, src FROM g),
r(v, l) USING KEY (v) AS (
  SELECT DISTINCT s, s FROM e
  UNION
  SELECT e.t, min(r.l) FROM r JOIN e ON e.s = r.v JOIN recurring.r k ON k.v = e.t
  WHERE r.l < k.l GROUP BY e.t),
labels AS (SELECT v AS id, l AS component FROM r),
sizes AS (SELECT component, count(*) AS size FROM labels GROUP BY component)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def _label_query(graph: str, select: str = "SELECT id, component FROM labels") -> str:
    return _with(_labels(graph), select=select, recursive=True)


HEARD = """m AS (SELECT s, least(s, min(t)) m FROM e GROUP BY s),
h AS (SELECT s AS id, m AS nbr FROM m
      UNION SELECT e.t, m.m FROM e JOIN m ON e.s = m.s WHERE m.m < e.s)"""
HEARD_UNPRUNED = """m AS (SELECT s, least(s, min(t)) m FROM e GROUP BY s),
h AS (SELECT s AS id, m AS nbr FROM m UNION SELECT e.t, m.m FROM e JOIN m ON e.s = m.s)"""
HEARD_MIN = "a AS (SELECT id, min(nbr) m, count(*) n FROM h GROUP BY id)"
TREE = "tree AS (SELECT id, min(nbr) AS parent FROM h GROUP BY id HAVING NOT bool_or(nbr = id))"
FIRST_PARENTS = "p AS (SELECT s AS id, least(s, min(t)) AS parent FROM e GROUP BY s)"
CCF = """m AS (SELECT s AS id, least(s, min(t)) m FROM e GROUP BY s),
known AS (SELECT id, m AS nbr FROM m WHERE m < id
          UNION ALL SELECT e.t, m.m FROM e JOIN m ON e.s = m.id WHERE m.m < e.s AND e.t <> m.m)"""
LARGE = """m AS (SELECT s AS id, least(s, min(t)) m FROM e GROUP BY s),
large AS (SELECT e.t AS id, m.m AS nbr FROM e JOIN m ON e.s = m.id WHERE e.t > e.s
          UNION SELECT id, m FROM m)"""
SMALL = """lm AS (SELECT id, min(nbr) m FROM large GROUP BY id),
small AS (SELECT large.nbr AS id, lm.m AS nbr FROM large JOIN lm USING (id)
          UNION SELECT id, m FROM lm)"""
SPLIT = f"""d AS (SELECT s, count(*) n FROM e GROUP BY s),
split AS (
  SELECT e.s AS id, 0 AS salt, CASE WHEN n > {HUB_DEGREE} THEN e.s ELSE e.t END AS nbr,
         CASE WHEN n > {HUB_DEGREE} THEN 1 + e.t % {SALTS} ELSE 0 END AS nbr_salt
  FROM e JOIN d USING (s)
  UNION SELECT e.s, 1 + e.t % {SALTS}, e.t, 0 FROM e JOIN d USING (s) WHERE n > {HUB_DEGREE})"""
HOOK_FOREST = """f AS (SELECT s AS id, least(s, min(t)) p, min(t) q FROM e GROUP BY s),
p AS (SELECT id, CASE WHEN p = id AND id NOT IN (SELECT p FROM f WHERE p <> id) THEN q ELSE p END
             AS parent FROM f)"""
STARS = """gp AS (SELECT a.id, a.parent, b.parent gp FROM p a JOIN p b ON a.parent = b.id),
deep AS (SELECT id FROM gp WHERE parent <> gp UNION SELECT gp FROM gp WHERE parent <> gp),
st AS (SELECT id, parent,
              id NOT IN (SELECT id FROM deep) AND parent NOT IN (SELECT id FROM deep) AS is_star
       FROM p)"""


def _candidates(condition: str) -> str:
    return f"""cd AS (SELECT a.parent AS id, min(b.parent) AS cand
  FROM e JOIN p a ON e.s = a.id JOIN p b ON e.t = b.id WHERE {condition} GROUP BY a.parent)"""


def _hook_query(condition: str, hooks: str) -> str:
    return _with(
        _edges(EVENT_USER),
        HOOK_FOREST,
        STARS,
        _candidates(condition),
        select=f"""SELECT st.id, CASE WHEN is_star AND st.id = parent AND cand IS NOT NULL
    AND {hooks} THEN cand ELSE parent END AS parent
FROM st LEFT JOIN cd ON st.id = cd.id""",
    )


# Documents of one text form a star around the least of them: one round, in which the large-star
# step sends each leaf the centre twice and the small-star step once.
DOC_STARS = """groups AS (SELECT count(*) n FROM documents GROUP BY md5(text) HAVING count(*) > 1),
totals AS (SELECT sum(n)::BIGINT v, count(*) c, max(n) w FROM groups)"""
DOC_MESSAGES = f"""{DOC_STARS},
sent AS (SELECT 1 AS step, 2 * (v - c) AS n, v - c AS receivers FROM totals
         UNION ALL SELECT 2, v - c, v - c FROM totals)"""
DOC_LABELS = """labels AS (
  SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS component FROM documents),
sizes AS (SELECT component, count(*) AS size FROM labels GROUP BY component)"""


def library_sql() -> dict[str, str]:
    on_parts = partial(_with, _edges(ORDER_PART))
    on_events = partial(_with, _edges(EVENT_USER))
    largest = """SELECT g.src, g.dst FROM g JOIN labels ON g.dst = labels.id
  WHERE component = (SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1)"""
    both = f"""largest AS ({largest}),
directed AS (SELECT src, dst FROM largest UNION ALL SELECT dst, src FROM largest)"""
    oracle = {
        "cc_documents": _with(DOC_LABELS, select="SELECT id, component FROM labels"),
        "cc_cust_order": _label_query(CUST_ORDER),
        "cc_tree_pruning_oblivious": _label_query(ORDER_PART),
        "cc_hash_min": _label_query(ORDER_PART),
        "cc_hash_min_hubs": _label_query(ORDER_PART),
        "cc_sgc_hubs": _label_query(ORDER_PART),
        "cc_alternating_hub_trees": _label_query(ORDER_PART),
        "cc_alternating_hub_default": _label_query(EVENT_USER),
        "cc_alternating_hub_split": _label_query(ORDER_PART),
        "parse_edge_lines": """
WITH lines AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_returnflag) AS value FROM lineitem
  UNION ALL SELECT text FROM documents),
fields AS (SELECT string_split(value, '|') f FROM lines),
parsed AS (SELECT CASE WHEN regexp_full_match(f[1], '[+-]?[0-9]+') THEN try_cast(f[1] AS BIGINT) END src,
                  CASE WHEN regexp_full_match(f[2], '[+-]?[0-9]+') THEN try_cast(f[2] AS BIGINT) END dst
           FROM fields)
SELECT src, dst FROM parsed WHERE src IS NOT NULL AND dst IS NOT NULL""",
        "read_edge_list": ORDER_PART,
        "parse_membership_lines": "SELECT l_partkey AS vertex, l_orderkey::VARCHAR AS arc FROM lineitem",
        "symmetrize": f"WITH g AS ({ORDER_PART}) SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g",
        "adjacency": f"""WITH g AS ({ORDER_PART})
SELECT src AS id, dst AS nbr FROM g UNION SELECT dst, src FROM g""",
        "co_occurrence_star": f"""
WITH m AS ({MEMBERS}), a AS (SELECT arc, min(vertex) least FROM m GROUP BY arc)
SELECT a.least AS src, m.vertex AS dst FROM m JOIN a USING (arc) WHERE m.vertex <> a.least""",
        "co_occurrence_degrees": f"""
WITH m AS ({MEMBERS})
SELECT a.vertex, count(*) AS pairs FROM m a JOIN m b ON a.arc = b.arc AND a.vertex <> b.vertex
GROUP BY a.vertex""",
        "membership_counts": f"""
WITH m AS ({MEMBERS})
SELECT (SELECT count(*) FROM m) AS edges,
       (SELECT count(DISTINCT a.vertex) FROM m a JOIN m b ON a.arc = b.arc AND a.vertex <> b.vertex)
         AS vertices""",
        "graph_counts": f"""
WITH g AS ({EVENT_USER})
SELECT (SELECT count(*) FROM g) AS edges,
       (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS vertices""",
        "min_selection": on_parts(HEARD, select="SELECT id, nbr FROM h"),
        "min_selection_unpruned": on_parts(HEARD_UNPRUNED, select="SELECT id, nbr FROM h"),
        "prune_links": on_parts(
            HEARD,
            HEARD_MIN,
            select="""SELECT h.nbr AS id, a.m AS nbr FROM h JOIN a USING (id) WHERE n > 1 AND h.nbr <> a.m
UNION SELECT a.m, h.nbr FROM h JOIN a USING (id) WHERE n > 1""",
        ),
        "prune_links_oblivious": on_parts(
            HEARD,
            HEARD_MIN,
            select="""SELECT h.nbr AS id, a.m AS nbr FROM h JOIN a USING (id) WHERE n > 1 AND h.nbr <> a.m
UNION SELECT m, m FROM a WHERE n > 1""",
        ),
        "prune_tree_edges": on_parts(HEARD, TREE, select="SELECT id, parent FROM tree"),
        "merge_forest": on_parts(
            HEARD,
            TREE,
            select="SELECT v.s AS id, tree.parent FROM (SELECT DISTINCT s FROM e) v LEFT JOIN tree ON tree.id = v.s",
        ),
        "prepare_propagation": on_parts(
            HEARD,
            TREE,
            select="""SELECT id, parent FROM tree
UNION SELECT parent, parent FROM tree WHERE parent NOT IN (SELECT id FROM tree)""",
        ),
        "propagate": _with(
            _edges(EVENT_USER),
            FIRST_PARENTS,
            """walk(id, seen) AS (
  SELECT id, parent FROM p
  UNION SELECT walk.id, p.parent FROM walk JOIN p ON p.id = walk.seen WHERE p.parent <> walk.seen)""",
            select="SELECT id, min(seen) AS component FROM walk GROUP BY id",
            recursive=True,
        ),
        "hash_min_round": on_events(
            "l AS (SELECT s AS id, min(t) AS label FROM e GROUP BY s)",
            select="""SELECT id, min(label) AS label FROM (SELECT id, label FROM l
  UNION ALL SELECT e.s, l.label FROM e JOIN l ON e.t = l.id) GROUP BY id""",
        ),
        "hash_to_min_round": on_events(
            "c AS (SELECT s AS id, t AS member FROM e UNION SELECT s, s FROM e)",
            "m AS (SELECT id, min(member) m FROM c GROUP BY id)",
            select="""SELECT m.m AS id, c.member FROM c JOIN m USING (id)
UNION SELECT c.member, m.m FROM c JOIN m USING (id) WHERE c.member <> m.m
UNION SELECT id, m FROM m""",
        ),
        "ccf_iterate": on_events(CCF, select="SELECT id, nbr FROM known"),
        "ccf_dedup": on_events(CCF, select="SELECT DISTINCT id, nbr FROM known"),
        "ccmr_round": on_events(
            "a AS (SELECT s AS id, min(t) f, max(t) x FROM e GROUP BY s)",
            "j AS (SELECT a.id, e.t AS nbr, f, x FROM e JOIN a ON e.s = a.id)",
            select="""SELECT id, nbr FROM j WHERE id < f
UNION SELECT f, nbr FROM j WHERE id > f AND nbr <> f
UNION SELECT nbr, f FROM j WHERE id > f AND nbr <> f
UNION SELECT id, f FROM j WHERE id > f AND id < x""",
        ),
        "large_star": on_parts(LARGE, select="SELECT id, nbr FROM large"),
        "small_star": on_parts(LARGE, SMALL, select="SELECT id, nbr FROM small"),
        "split_hubs": on_parts(
            SPLIT, select="SELECT id, salt::INTEGER AS salt, nbr, nbr_salt::INTEGER AS nbr_salt FROM split"
        ),
        "split_hub_trees": on_parts(
            select="SELECT s AS id, count(*)::BIGINT AS edges, 0::BIGINT AS above_limit FROM e GROUP BY s"
        ),
        "degree_limit": on_events(
            "d AS (SELECT count(*)::DOUBLE AS n FROM e GROUP BY s)",
            "l AS (SELECT (1::BIGINT << b::INTEGER) AS most FROM range(2, 62) r(b))",
            select="""SELECT min(most) AS degree_limit FROM l
WHERE 2 * coalesce((SELECT sum(n) FROM d WHERE n >= most), 0)
    <= 0.01::DOUBLE * (SELECT sum(n) FROM d) * (most - 1)""",
        ),
        "drop_virtual": on_parts(
            SPLIT,
            select="""SELECT id, least(id * 16, min(nbr * 16 + nbr_salt)) // 16 AS component
FROM split WHERE salt = 0 GROUP BY id""",
        ),
        "labels_changed": on_events(
            LARGE,
            SMALL,
            "new AS (SELECT id, least(id, min(nbr)) l FROM small GROUP BY id)",
            select="""SELECT count(*) AS changed FROM m FULL JOIN new ON m.id = new.id
WHERE m.m IS DISTINCT FROM new.l""",
        ),
        "forest_init": on_events(HOOK_FOREST, select="SELECT id, parent FROM p"),
        "star_detection": on_events(
            HOOK_FOREST, STARS, select="SELECT id, parent, is_star FROM st"
        ),
        "contract_edges": on_events(
            FIRST_PARENTS,
            select="""SELECT DISTINCT greatest(a.parent, b.parent) AS id, least(a.parent, b.parent) AS nbr
FROM e JOIN p a ON a.id = e.s JOIN p b ON b.id = e.t WHERE a.parent <> b.parent""",
        ),
        "min_neighbour_parent": on_events(
            HOOK_FOREST, _candidates("TRUE"), select="SELECT id, cand FROM cd"
        ),
        "min_neighbour_parent_unconditional": on_events(
            HOOK_FOREST, _candidates("a.parent <> b.parent"), select="SELECT id, cand FROM cd"
        ),
        "conditional_star_hook": _hook_query("TRUE", "cand < parent"),
        "unconditional_star_hook": _hook_query("a.parent <> b.parent", "TRUE"),
        "pointer_jump": on_events(
            FIRST_PARENTS, select="SELECT a.id, b.parent FROM p a JOIN p b ON a.parent = b.id"
        ),
        "canonical_label": on_events(
            HOOK_FOREST,
            select="""SELECT p.id, k.component
FROM p JOIN (SELECT parent, min(id) component FROM p GROUP BY parent) k USING (parent)""",
        ),
        "degree_stats": f"""
WITH g AS ({ORDER_PART}), e AS (SELECT src s, dst t FROM g UNION SELECT dst, src FROM g),
d AS (SELECT s, count(*) n FROM e GROUP BY s)
SELECT count(*) AS vertices, sum(n)::BIGINT AS edges, sum(n)::DOUBLE / count(*) AS mean_degree,
       max(n) AS max_degree FROM d""",
        "component_sizes": _label_query(CUST_ORDER, "SELECT component, size FROM sizes"),
        "component_counts": _with(
            DOC_LABELS,
            select="""SELECT count(*) AS components,
  count(*) FILTER (size <> 1) AS components_without_singletons FROM sizes""",
        ),
        "max_component_size": _label_query(CUST_ORDER, "SELECT max(size) AS max_size FROM sizes"),
        "size_distribution": _label_query(
            CUST_ORDER, "SELECT size, count(*) AS components FROM sizes GROUP BY size"
        ),
        "largest_component": _label_query(
            CUST_ORDER, "SELECT component, size FROM sizes ORDER BY size DESC, component LIMIT 1"
        ),
        "largest_component_edges": _with(
            _labels(CUST_ORDER), both, select="SELECT src, dst FROM directed", recursive=True
        ),
        "run_summary": _with(
            DOC_LABELS,
            DOC_MESSAGES,
            select="""SELECT 'alternating' AS algorithmName, 'docs' AS dataset,
  (SELECT sum(n)::BIGINT FROM sent) AS reduceInputMessageNumber,
  (SELECT 2 * sum(n)::BIGINT FROM sent) AS reduceInputSize, count(*) AS ccNumber,
  count(*) FILTER (size <> 1) AS ccNumberNoIsolatedVertices, max(size) AS ccMaxSize,
  'all documents' AS customColumn FROM sizes""",
        ),
        "step_activity": _with(
            DOC_STARS,
            """steps AS (SELECT 0 AS step, 2 * (v - c) AS edges, w - 1 AS degree, v AS active, v FROM totals
  UNION ALL SELECT 1, v - c, 1, v - c, v FROM totals
  UNION ALL SELECT 2, v - c, 1, v - c, v FROM totals)""",
            select="""SELECT 'docs' AS dataset, step::INTEGER AS step, active AS activeVertices,
  round(100.0::DOUBLE * active / v, 2) AS activeVerticesNormalized, 'alternating' AS algorithm,
  edges::DOUBLE AS activeEdges, edges::DOUBLE / active AS meanDegree, degree::BIGINT AS degreeMax
FROM steps""",
        ),
        "step_times": """SELECT 'docs' AS dataset, 'alternating' AS algorithm, step, true AS timed
FROM (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS step) WHERE EXISTS (SELECT * FROM documents)""",
        "step_messages": _with(
            DOC_MESSAGES,
            select="""SELECT 'docs' AS dataset, 'alternating' AS algorithm, step::INTEGER AS step,
  n AS messageNumber, 2 * n AS messageSize, receivers FROM sent""",
        ),
        "write_labels": _with(
            DOC_LABELS, select="SELECT concat(id, ' ', component) AS line FROM labels"
        ),
        "write_edges": f"WITH g AS ({ORDER_PART}) SELECT concat(src, ' ', dst) AS line FROM g",
        "write_distribution": _with(
            DOC_LABELS,
            select="SELECT concat(size, ',', count(*)) AS line FROM sizes GROUP BY size",
        ),
        "write_largest_component": _with(
            _labels(CUST_ORDER),
            both,
            select="SELECT concat(src, ' ', dst) AS line FROM directed",
            recursive=True,
        ),
        "write_stats": _with(
            DOC_MESSAGES,
            select="""SELECT concat_ws(',', 'docs', 'alternating', step, n, 2 * n, receivers) AS line
FROM sent""",
        ),
    }
    for name in (
        "cc_tree_pruning",
        "cc_tree_pruning_opt",
        "cc_tree_pruning_balanced",
        "cc_hash_to_min",
        "cc_ccf",
        "cc_ccmr",
        "cc_alternating",
        "cc_sgc",
        "cc_hash_min_deep",
    ):
        oracle[name] = _label_query(EVENT_USER)
    return oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = library_queries()
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = library_sql()
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
