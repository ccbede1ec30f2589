"""Connected components of an edge table whose rounds are tables in the shared folder; see `lattica.plans.stars`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stars import local_roots, stars
from .common import written

__all__ = ["connected_components", "local_roots"]


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a long, b long) that has another one for a neighbour; component is the least
    node. edges are read once."""
    found = stars(edges, lambda df: written(df, label))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(found.select("b", "b")).distinct()
