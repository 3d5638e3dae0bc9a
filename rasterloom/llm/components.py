"""Connected components over a workspace's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import links
from .store import Workspace


def connected_components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) for every node in edges(a, b); component is the smallest id reachable."""
    return links.connected_components(edges, lambda df: work.keep(df, "stars"), work.drop)
