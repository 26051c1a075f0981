"""Connected components of large graphs held as Spark tables."""

from islets.plans.algorithms import ALGORITHMS
from islets.plans.components import ComponentRun, connected_components, run_components

__all__ = ["ALGORITHMS", "ComponentRun", "connected_components", "run_components"]
