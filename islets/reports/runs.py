"""Reports on a run: one row per step, or one row in all, as typed frames.

Column names of these records are fixed, so that existing readers of such records keep working.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from islets.plans.components import ComponentRun
from islets.reports.components import component_sizes

ACTIVITY_SCHEMA = (
    "dataset string, step int, activeVertices long, activeVerticesNormalized double, "
    "algorithm string, activeEdges double, meanDegree double, degreeMax long"
)
MESSAGE_SCHEMA = (
    "dataset string, algorithm string, step int, messageNumber long, messageSize long, "
    "receivers long"
)
TIME_SCHEMA = "dataset string, algorithm string, step int, time long"


def _frame(run: ComponentRun, rows: list[tuple], schema: str) -> DataFrame:
    return run.labels.sparkSession.createDataFrame(rows, schema)


def _need_stats(run: ComponentRun) -> None:
    if not run.collect_stats:
        raise ValueError("this report needs a run with collect_stats=True")


def step_activity(run: ComponentRun) -> DataFrame:
    """Vertices and edges that each step left active; step 0 is the graph as loaded."""
    _need_stats(run)
    at_start = run.steps[0].receivers
    rows = []
    for record in run.steps:
        active = record.receivers
        share = round(100.0 * active / at_start, 2) if at_start else 0.0
        mean = record.active_edges / active if active else 0.0
        rows.append(
            (
                run.dataset,
                record.step,
                active,
                share,
                run.algorithm,
                float(record.active_edges),
                mean,
                record.degree_max,
            )
        )
    return _frame(run, rows, ACTIVITY_SCHEMA)


def step_messages(run: ComponentRun) -> DataFrame:
    """Rows sent by each step before any combining, their size in ids (receiver and value), and
    how many vertices got some."""
    _need_stats(run)
    rows = [
        (run.dataset, run.algorithm, r.step, r.messages, 2 * r.messages, r.receivers)
        for r in run.steps
        if r.messages is not None
    ]
    return _frame(run, rows, MESSAGE_SCHEMA)


def step_times(run: ComponentRun) -> DataFrame:
    """Milliseconds per step."""
    rows = [(run.dataset, run.algorithm, r.step, r.millis) for r in run.steps]
    return _frame(run, rows, TIME_SCHEMA)


def run_summary(run: ComponentRun, custom_column: str = "") -> DataFrame:
    """One row on the whole run and its result; message totals are 0 without statistics."""
    sent = sum(r.messages or 0 for r in run.steps)
    partitions = run.labels.sparkSession.conf.get("spark.sql.shuffle.partitions")
    found = component_sizes(run.labels).agg(
        F.count(F.lit(1)).alias("ccNumber"),
        F.count_if(F.col("size") != 1).alias("ccNumberNoIsolatedVertices"),
        F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("ccMaxSize"),
    )
    return found.select(
        F.lit(run.algorithm).alias("algorithmName"),
        F.lit(run.dataset).alias("dataset"),
        F.lit(int(partitions)).alias("partition"),
        F.lit(max(len(run.steps) - 1, 0)).alias("step"),
        F.lit(run.millis_all).cast("long").alias("timeAll"),
        F.lit(run.millis_all).cast("long").alias("timeLoadingAndComputation"),
        F.lit(run.millis_computation).cast("long").alias("timeComputation"),
        F.lit(sent).cast("long").alias("reduceInputMessageNumber"),
        F.lit(2 * sent).cast("long").alias("reduceInputSize"),
        "ccNumber",
        "ccNumberNoIsolatedVertices",
        "ccMaxSize",
        F.lit(custom_column).alias("customColumn"),
    )
