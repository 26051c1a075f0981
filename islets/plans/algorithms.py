"""The nine component algorithms as loops of DataFrame steps.

Each function takes a run and a graph with at least one edge and returns ``(id, component)`` for all
vertices that have an edge, ``component`` being the least id of the component.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.operators.ccf import ccf_iterate
from islets.operators.ccmr import ccmr_messages
from islets.operators.clusters import cluster_messages
from islets.operators.hooking import (
    canonical_label,
    conditional_star_hook,
    contract_edges,
    forest_init,
    least_across,
    star_detection,
    unconditional_star_hook,
)
from islets.operators.hub_trees import (
    LEAST_LIMIT,
    degree_histogram,
    degree_limit,
    named_trees,
    numbered_links,
    split_hub_trees,
    vertex_numbers,
)
from islets.operators.lookup import Hubs
from islets.operators.min_label import label_news, merge_labels, shortcut_messages, with_kept
from islets.operators.rows import local_minimum
from islets.operators.stars import (
    as_vertex_pairs,
    drop_virtual,
    follow_links,
    large_star,
    local_maxima,
    orient,
    small_star,
    split_hubs,
    star_labels,
    without_maxima,
)
from islets.operators.tree_pruning import (
    heard_minima,
    min_selection,
    pointer_jump,
    prepare_propagation,
    prune_links,
    prune_tree_edges,
)
from islets.plans.adjacency import bucket_count, bucketed_adjacency
from islets.plans.graph import Graph
from islets.plans.rounds import Rounds
from islets.plans.workspace import Table


def _replace(run: Rounds, old: Table | None, new: Table) -> Table:
    if old is not None:
        run.work.drop(old)
    return new


def _edge_degrees(run: Rounds, graph: Graph, hubs: Hubs | None) -> DataFrame | None:
    """Vertices with many edges, counted once for loops that join the same edges each round."""
    if hubs is None:
        return None
    counts = graph.symmetric().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return run.work.save(counts.where(F.col("n") > hubs.limit), "hubs").frame


def propagate(run: Rounds, parents: Table) -> Table:
    """Point every vertex of a forest at its root: pointers double their reach with each jump."""
    while True:
        run.next_round()
        hubs = run.hubs(parents.rows)
        jumped = pointer_jump(parents.frame, hubs=hubs, with_old=True)
        table = run.work.save(
            jumped, "propagate", drop=("old",), moved=F.count_if(F.col("old") != F.col("parent"))
        )
        run.record("propagate", table, table.rows)
        parents = _replace(run, parents, table)
        if not parents.counts["moved"]:
            return parents


def tree_pruning(
    run: Rounds,
    graph: Graph,
    *,
    edge_pruning: bool = False,
    oblivious_seed: bool | Collection[int] = False,
) -> DataFrame:
    """Alternate min selection and pruning until no live row is left, then propagate.

    ``oblivious_seed`` is a flag or the set of rounds (from 0) in which it holds.
    """
    hubs = run.hubs(2 * graph.links)
    messages = min_selection(
        graph.symmetric(), edge_pruning=edge_pruning, hubs=hubs, dedup=False
    )
    heard = run.step("min_selection", messages)
    tree_edges: list[DataFrame] = []
    rounds: list[Table] = []
    while heard.rows:
        run.next_round()
        oblivious = (
            oblivious_seed
            if isinstance(oblivious_seed, bool)
            else len(rounds) in oblivious_seed
        )
        hubs = run.hubs(heard.rows)
        # What both halves of the step start from is written, so that what the vertices heard
        # is aggregated once and goes as soon as the links are there.
        minima = run.work.save(heard_minima(heard.frame), "minima")
        links = prune_links(
            heard.frame, minima.frame, oblivious_seed=oblivious, hubs=hubs, dedup=False
        )
        live = run.step("prune", links)
        tree_edges.append(prune_tree_edges(minima=minima.frame))
        rounds.append(minima)
        run.work.drop(heard)
        messages = min_selection(
            live.frame, edge_pruning=edge_pruning, hubs=run.hubs(live.rows), dedup=False
        )
        heard = run.step("min_selection", messages)
        run.work.drop(live)
    forest = run.save(
        "prepare_propagation", prepare_propagation(reduce(DataFrame.unionByName, tree_edges))
    )
    for table in rounds:
        run.work.drop(table)
    roots = propagate(run, forest)
    return roots.frame.select("id", F.col("parent").alias("component"))


def tree_pruning_opt(
    run: Rounds,
    graph: Graph,
    *,
    edge_pruning: bool = True,
    oblivious_seed: bool | Collection[int] = False,
) -> DataFrame:
    """Tree pruning with edge pruning, and its further options."""
    return tree_pruning(
        run,
        graph,
        edge_pruning=edge_pruning,
        oblivious_seed=oblivious_seed,
    )


def hash_min(run: Rounds, graph: Graph) -> DataFrame:
    """Spread labels until none changes; only changed labels are sent again.

    Edges and labels lie in buckets, so all that a round shuffles are the messages, combined before.
    A label names a vertex of the component, so after each hop labels also move along the labels
    themselves: without that, a round a hop is needed, and deep graphs have many.
    """
    hubs = run.hubs(2 * graph.links)
    degrees = _edge_degrees(run, graph, hubs)
    adjacency = bucketed_adjacency(run, graph.symmetric(), hubs, degrees)
    by_id = ("id", bucket_count(run))
    first = local_minimum(graph.symmetric()).select(
        "id", F.col("m").alias("label"), (F.col("m") < F.col("id")).alias("changed")
    )
    labels = run.save("start", first, buckets=by_id, changed=F.count_if("changed"))
    while labels.counts["changed"]:
        run.next_round()
        heard = adjacency.heard(label_news(labels.frame))
        messages = with_kept(labels.frame, heard)
        spread = run.step("hash_min", messages, merge_labels)
        labels = _replace(run, labels, spread)
        known = shortcut_messages(labels.frame, hubs=run.hubs(labels.rows))
        new = run.step(
            "shortcut", known, merge_labels, buckets=by_id, changed=F.count_if("changed")
        )
        labels = _replace(run, labels, new)
    adjacency.drop(run)
    return run.work.unlist(labels).select("id", F.col("label").alias("component"))


def hash_to_min(run: Rounds, graph: Graph) -> DataFrame:
    """Exchange clusters until no row comes or goes."""

    def merge(messages, *extra):
        if not extra:
            return messages.distinct()
        return messages.groupBy("id", "member").agg(*extra)

    checksum = F.bit_xor(F.xxhash64("id", "member"))
    start = graph.symmetric().select("id", F.col("nbr").alias("member"))
    start = start.unionByName(graph.linked_vertices().select("id", F.col("id").alias("member")))
    clusters = run.save("start", start, checksum=checksum)
    while True:
        run.next_round()
        sent = cluster_messages(clusters.frame, hubs=run.hubs(clusters.rows))
        new = run.step("hash_to_min", sent, merge, checksum=checksum)
        unchanged = _same_rows(clusters, new)
        clusters = _replace(run, clusters, new)
        if unchanged:
            break
    return clusters.frame.groupBy("id").agg(F.min("member").alias("component"))


def _same_rows(before: Table, after: Table) -> bool:
    """Whether two tables of distinct rows are the same set.

    Counts and checksums, known from writing, tell most rounds apart; only if they agree are the
    rows compared.
    """
    if before.rows != after.rows or before.counts["checksum"] != after.counts["checksum"]:
        return False
    gone = before.frame.join(after.frame, before.frame.columns, "left_anti")
    return gone.isEmpty()


def _is_star_forest(graph: Graph, links: Table) -> bool:
    """Whether distinct links from larger to smaller ids are stars, one per component.

    Let L be the number of links, C of their distinct ``nbr`` and D of their distinct ``id``.  Links
    touch all n vertices, so every vertex outside D is in C: L >= D and C >= n - D.  Hence
    L + C >= n, with equality only if every id has one link and no centre has a link itself.
    Most rounds fail on L alone, which the write has counted.
    """
    if links.rows >= graph.count:
        return False
    centres = links.frame.select("nbr").distinct().count()
    return links.rows + centres == graph.count


def _labels_of_stars(links: DataFrame) -> DataFrame:
    """Labels from a star forest; the links have one row per leaf, so only centres are shuffled."""
    centres = links.select(F.col("nbr").alias("id"), F.col("nbr").alias("component")).distinct()
    return links.select("id", F.col("nbr").alias("component")).unionByName(centres)


def ccf(run: Rounds, graph: Graph) -> DataFrame:
    """Iterate and deduplicate until no vertex has a new pair to tell, i.e. all links are stars."""
    graph.count = graph.linked_vertices().count()
    pairs = graph.table
    frame, rows = graph.edges(), graph.links
    while True:
        run.next_round()
        hubs = run.hubs(2 * rows)
        messages = ccf_iterate(frame, hubs=hubs)
        new = run.step("ccf", messages)
        pairs = _replace(run, pairs if pairs is not graph.table else None, new)
        frame, rows = pairs.frame, pairs.rows
        if _is_star_forest(graph, pairs):
            return _labels_of_stars(frame)


def ccmr(run: Rounds, graph: Graph) -> DataFrame:
    """Pass lists on to their first member until only local minima hold any."""

    def merge(messages, *extra):
        return messages.groupBy("id", "nbr").agg(F.max("more").alias("more"), *extra)

    state: Table | None = None
    frame, rows = graph.symmetric(), 2 * graph.links
    while True:
        run.next_round()
        messages = ccmr_messages(frame, hubs=run.hubs(rows))
        new = run.step("ccmr", messages, merge, drop=("more",), more=F.count_if("more"))
        state = _replace(run, state, new)
        frame, rows = state.frame, state.rows
        if not state.counts["more"]:
            break
    return frame.select(F.col("nbr").alias("id"), F.col("id").alias("component")).unionByName(
        frame.select("id", F.col("id").alias("component")).distinct()
    )


def _alternate(run: Rounds, graph: Graph, frame: DataFrame, rows: int) -> Table:
    """Large-star and small-star until the links are stars, which saves a round that changes nothing."""
    state: Table | None = None
    while True:
        run.next_round()
        links = large_star(
            frame, hubs=run.hubs(rows), dedup=False, oriented=True, loops=False
        )
        large = run.step("large_star", links, about=2 * rows)
        hubs = run.hubs(large.rows)
        links = small_star(large.frame, hubs=hubs, dedup=False, oriented=True, loops=False)
        new = run.step("small_star", links, about=2 * large.rows)
        run.work.drop(large)
        state = _replace(run, state, new)
        frame, rows = state.frame, state.rows
        if _is_star_forest(graph, state):
            return state


def _shrinking_stars(run: Rounds, frame: DataFrame, rows: int) -> list[Table]:
    """Star links of all vertices: large-star and small-star alternate among ever fewer of them.

    After each round, vertices without a larger neighbour are set aside: they hang on their least neighbour, to
    which the others are linked in their place.  Stars kept whole would travel in each round.  Once no link is left,
    those set aside are led to the centres, last round first.  They hang on smaller ones, so the least vertex of a
    component is never set aside.
    """
    live: Table | None = None
    aside: list[Table] = []
    while rows:
        run.next_round()
        hubs = run.hubs(rows, frame, "nbr")
        links = large_star(frame, hubs=hubs, dedup=False, oriented=True, loops=False)
        large = run.step("large_star", links, about=2 * rows)
        hubs = run.hubs(large.rows, large.frame, "id")
        links = small_star(large.frame, hubs=hubs, dedup=False, oriented=True, loops=False)
        small = run.step("small_star", links, about=2 * large.rows)
        run.work.drop(large)
        maxima = run.save("set_aside", local_maxima(small.frame))
        aside.append(maxima)
        hubs = run.hubs(small.rows, small.frame, "id")
        left = run.save("live", without_maxima(small.frame, maxima.frame, hubs=hubs))
        run.work.drop(small)
        live = _replace(run, live, left)
        frame, rows = live.frame, live.rows
    run.work.drop(live)
    stars = [aside.pop()]
    while aside:
        hanging = aside.pop()
        hubs = run.hubs(hanging.rows, hanging.frame, "nbr")
        stars.append(run.save("follow_links", follow_links(hanging.frame, _rows_of(stars), hubs=hubs)))
        run.work.drop(hanging)
    return stars


def _rows_of(tables: list[Table]) -> DataFrame:
    return reduce(DataFrame.unionByName, (table.frame for table in tables))


def alternating(run: Rounds, graph: Graph) -> DataFrame:
    graph.count = graph.linked_vertices().count()
    stars = _alternate(run, graph, graph.edges(), graph.links)
    return _labels_of_stars(stars.frame)


def alternating_hub_split(
    run: Rounds,
    graph: Graph,
    *,
    hub_degree: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Star alternation after splitting vertices with more than ``hub_degree`` neighbours.

    Hubs become trees of virtual vertices; without ``hub_degree`` the limit comes from the histogram of
    degrees.  If no degree is above the limit, the graph is its own split and nothing is written.
    ``salts`` asks for that many virtual vertices a hub instead, in one level; so does a ``hub_degree``
    too small for a tree (:data:`LEAST_LIMIT`), with as many as it takes.
    """
    if salts is not None or (hub_degree is not None and hub_degree < LEAST_LIMIT):
        return _alternating_salted(run, graph, hub_degree, salts)
    counted = graph.symmetric().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    degrees = run.save("degrees", counted, most=F.max("n"))
    degree = hub_degree or degree_limit(degree_histogram(degrees.frame)).first()["degree_limit"]
    graph.count = degrees.rows
    if degrees.counts["most"] <= degree:
        run.work.drop(degrees)
        return _labels_of_stars(_alternate(run, graph, graph.edges(), graph.links).frame)
    hubs = run.hubs(2 * graph.links) if degrees.counts["most"] > run.hub_rows else None
    split = split_hub_trees(
        graph.symmetric(), degree=degree, degrees=degrees.frame, hubs=hubs, keep=run.keep
    )
    table = run.save("split_hubs", split)
    run.work.drop(degrees)
    # the rounds run on longs: least structs are found by sorting, least longs by hashing
    numbers = run.work.save(vertex_numbers(table.frame), "numbers")
    # no vertex has more links than ``degree`` now
    hubs = run.hubs(2 * table.rows) if degree > run.hub_rows else None
    links = run.save("number_vertices", numbered_links(table.frame, numbers.frame, hubs=hubs))
    run.work.drop(table)
    stars = _shrinking_stars(run, links.frame, links.rows)
    run.work.drop(links)
    trees = run.save("name_trees", named_trees(numbers.frame, _labels_of_stars(_rows_of(stars))))
    for table in (numbers, *stars):
        run.work.drop(table)
    return canonical_label(trees.frame, hubs=run.hubs(trees.rows, trees.frame, "parent"))


def _alternating_salted(run: Rounds, graph: Graph, hub_degree: int | None, salts: int | None) -> DataFrame:
    degree = hub_degree or run.hub_rows
    hubs = run.hubs(2 * graph.links)
    split = split_hubs(graph.symmetric(), degree=degree, salts=salts, hubs=hubs)
    table = run.save(
        "split_hubs", as_vertex_pairs(split), virtual=F.count_if(F.col("nbr.salt") > 0)
    )
    if not table.counts["virtual"]:
        run.work.drop(table)
        return alternating(run, graph)
    graph.count = (
        table.frame.select(F.explode(F.array("id", "nbr")).alias("id")).distinct().count()
    )
    stars = _alternate(run, graph, orient(table.frame), table.rows)
    run.work.drop(table)
    return drop_virtual(_labels_of_stars(stars.frame))


def sgc(run: Rounds, graph: Graph) -> DataFrame:
    """Hook stars onto each other and jump, until a jump moves no pointer.

    Before each hook the edges are contracted to the parents of their ends, so every join runs on the
    edges between trees that are still apart, each once.
    """
    parents = run.save("forest_init", forest_init(graph.symmetric()))
    hubs = run.hubs(parents.rows)
    live = None

    def hook(parents: DataFrame, conditional: bool) -> DataFrame:
        nonlocal live
        rows, edges = (live.rows, live.frame) if live else (graph.links, graph.edges())
        if rows:
            contracted = contract_edges(edges, parents, hubs=run.hubs(2 * rows))
            table = run.work.save(contracted, "contract_edges")
            run.record("contract_edges", table, table.rows)
            live = _replace(run, live, table)
        stars = star_detection(parents, hubs=hubs)
        candidates = least_across(live.frame)
        if conditional:
            return conditional_star_hook(stars, candidates)
        return unconditional_star_hook(stars, candidates)

    while True:
        run.next_round()
        for conditional in (True, False):
            if live and not live.rows:  # no tree has a neighbour any more
                break
            name = "conditional_star_hook" if conditional else "unconditional_star_hook"
            parents = _replace(run, parents, run.save(name, hook(parents.frame, conditional)))
        jumped = pointer_jump(parents.frame, hubs=hubs, with_old=True)
        table = run.work.save(
            jumped, "pointer_jump", drop=("old",), moved=F.count_if(F.col("old") != F.col("parent"))
        )
        run.record("pointer_jump", table, table.rows)
        parents = _replace(run, parents, table)
        if not table.counts["moved"]:
            break
    run.work.drop(live)
    return canonical_label(parents.frame, hubs=hubs)


ALGORITHMS = {
    "tree_pruning": tree_pruning,
    "tree_pruning_opt": tree_pruning_opt,
    "hash_min": hash_min,
    "hash_to_min": hash_to_min,
    "ccf": ccf,
    "ccmr": ccmr,
    "alternating": alternating,
    "alternating_hub_split": alternating_hub_split,
    "sgc": sgc,
}
