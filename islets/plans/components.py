"""Entry points: label the connected components of an edge table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from islets.operators.lookup import HUB_ROWS
from islets.plans.algorithms import ALGORITHMS
from islets.plans.graph import load_graph
from islets.plans.rounds import Rounds, StepRecord
from islets.plans.workspace import Workspace

DEFAULT_ALGORITHM = "alternating"


@dataclass
class ComponentRun:
    """Labels ``(id, component)`` and the record of how they came about.

    ``labels`` is a lazy frame over the tables of the last round.  ``work`` holds these tables.
    """

    labels: DataFrame
    algorithm: str
    rounds: int
    steps: list[StepRecord]
    millis_all: int
    millis_computation: int
    work: Workspace = field(repr=False)
    dataset: str = ""
    collect_stats: bool = False


def run_components(
    edges: DataFrame,
    algorithm: str = DEFAULT_ALGORITHM,
    *,
    vertices: DataFrame | None = None,
    src: str = "src",
    dst: str = "dst",
    dataset: str = "",
    collect_stats: bool = False,
    max_rounds: int | None = None,
    hub_rows: int = HUB_ROWS,
    rows: int | None = None,
    **options,
) -> ComponentRun:
    """Label the components of undirected ``edges`` and keep the statistics of the run.

    ``src`` and ``dst`` name two columns of one orderable type; rows with a NULL in them are left
    out, self-loops state that a vertex exists, copies do no harm.  ``vertices`` adds isolated
    vertices: ids in its first column.  ``collect_stats`` counts messages and activity per step, at
    the cost of one more aggregation each.  ``hub_rows`` is how many rows of one vertex a task may
    get before the vertex is treated as a hub.  ``rows`` is the number of rows of ``edges``, for
    callers that know it; it spares small graphs the tasks of large ones.  ``options`` go to the algorithm.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; there are {', '.join(ALGORITHMS)}")
    begin = time.monotonic()
    run = Rounds(
        edges.sparkSession,
        algorithm,
        collect_stats=collect_stats,
        max_rounds=max_rounds,
        hub_rows=hub_rows,
    )
    graph = load_graph(run, edges, vertices, src, dst, rows)
    run.loaded(graph.symmetric())
    loaded = time.monotonic()
    labels = ALGORITHMS[algorithm](run, graph, **options) if graph.links else None
    labels = graph.with_isolated(labels)
    end = time.monotonic()
    return ComponentRun(
        labels,
        algorithm,
        run.rounds,
        run.records,
        round(1000 * (end - begin)),
        round(1000 * (end - loaded)),
        run.work,
        dataset,
        collect_stats,
    )


def connected_components(
    edges: DataFrame, algorithm: str = DEFAULT_ALGORITHM, **options
) -> DataFrame:
    """``(id, component)`` for every vertex; arguments as in :func:`run_components`."""
    return run_components(edges, algorithm, **options).labels
