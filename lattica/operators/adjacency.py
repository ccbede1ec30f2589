"""Lookups, neighbour scans and degrees, for one vertex or for all."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..plans.loops import tasks_for, with_rank
from ..plans.model import Graph


MOST_DENSE = 20_000


def weights_of(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with w: the weight of the first edge from u to v in edge order, 0.0 for none and for vertices out of
    range. Only arcs that are asked for are aggregated."""
    arcs = graph.arcs()
    asked = arcs.repartition(tasks_for(arcs), "u", "v").join(pairs.select("u", "v").distinct(), ["u", "v"], "left_semi")
    first = asked.groupBy("u", "v").agg(F.min_by("w", "eid").alias("w"))
    return pairs.join(first, ["u", "v"], "left").select("u", "v", F.coalesce("w", F.lit(0.0)).alias("w"))


def edges_exist(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with found: whether there is an edge from u to v. An edge has a weight other than zero, so none is looked at."""
    there = graph.arcs().select("u", "v").join(pairs.select("u", "v").distinct(), ["u", "v"], "left_semi").distinct().withColumn("found", F.lit(True))
    return pairs.join(there, ["u", "v"], "left").select("u", "v", F.coalesce("found", F.lit(False)).alias("found"))


def get_weight(graph: Graph, u: int, v: int) -> float:
    """Filters are pushed to the edges, whichever way they run."""
    row = graph.arcs().where((F.col("u") == u) & (F.col("v") == v)).agg(F.min_by("w", "eid").alias("w")).first()
    return 0.0 if row.w is None else row.w


def has_edge(graph: Graph, u: int, v: int) -> bool:
    return get_weight(graph, u, v) != 0.0


def neighbors_out(graph: Graph, of: DataFrame) -> DataFrame:
    """(u, rank, v, w): successors of each vertex in of(u), ranked from 0 in the policy's order."""
    return _ranked(graph.arcs().join(of.select("u"), "u", "left_semi"), "u", "v")


def neighbors_in(graph: Graph, of: DataFrame) -> DataFrame:
    """(v, rank, u, w): predecessors of each vertex in of(v), ranked from 0 in the policy's order."""
    return _ranked(graph.arcs_in().join(of.select("v"), "v", "left_semi"), "v", "u")


def _ranked(arcs: DataFrame, of: str, other: str) -> DataFrame:
    return with_rank(arcs, "rank", of, "pos", "eid").select(of, "rank", other, "w")


def iter_out(graph: Graph, u: int) -> Iterator[tuple[int, float]]:
    """Pulls the successors of one vertex in order, without holding them all."""
    _vertex(graph, u)
    rows = graph.arcs().where(F.col("u") == u).orderBy("pos", "eid").select("v", "w")
    return ((r.v, r.w) for r in rows.toLocalIterator())


def iter_in(graph: Graph, v: int) -> Iterator[tuple[int, float]]:
    _vertex(graph, v)
    rows = graph.arcs_in().where(F.col("v") == v).orderBy("pos", "eid").select("u", "w")
    return ((r.u, r.w) for r in rows.toLocalIterator())


def _vertex(graph: Graph, v: int) -> None:
    if not 0 <= v < graph.n:
        raise InvalidArgument(f"vertex {v}")


def _degrees(graph: Graph, end: str) -> DataFrame:
    counted = graph.arcs().groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def out_degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every vertex: parallel arcs count each, a self-loop once."""
    return _degrees(graph, "u")


def in_degrees(graph: Graph) -> DataFrame:
    return _degrees(graph, "v" if graph.directed else "u")


def out_degree(graph: Graph, u: int) -> int:
    _vertex(graph, u)
    return graph.arcs().where(F.col("u") == u).count()


def in_degree(graph: Graph, v: int) -> int:
    _vertex(graph, v)
    return graph.arcs().where(F.col("v") == v).count()


def counts(graph: Graph) -> DataFrame:
    """One row: n, m, arcs, loops."""
    loop = F.col("src") == F.col("dst")
    arcs = F.lit(1) if graph.directed else F.when(loop, 1).otherwise(2)
    return graph.edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(arcs), F.lit(0)).alias("arcs"), F.count_if(loop).alias("loops")).select(F.lit(graph.n).cast("long").alias("n"), "m", "arcs", "loops")


def csr_offsets(graph: Graph) -> DataFrame:
    """(id, head): where the block of each vertex would start in one array of arcs ordered by u; id n has its length.

    Prefix sums run within ranges of vertices, and over the ranges' totals: no task holds more than a range.
    """
    width = max(1, -(-graph.n // 1024))
    degrees = out_degrees(graph).withColumn("block", F.floor(F.col("id") / width))
    totals = degrees.groupBy("block").agg(F.sum("degree").alias("total"))
    # at most 1024 rows are ordered in one task
    bases = totals.select("block", (F.sum("total").over(W.orderBy("block")) - F.col("total")).alias("base"))
    inside = F.sum("degree").over(W.partitionBy("block").orderBy("id")) - F.col("degree")
    heads = degrees.withColumn("inside", inside).join(F.broadcast(bases), "block").select("id", (F.col("base") + F.col("inside")).alias("head"))
    return heads.unionByName(counts(graph).select(F.col("n").alias("id"), F.col("arcs").alias("head")))


def adjacency(graph: Graph) -> DataFrame:
    """(u, neighbors): each vertex's arcs as an ordered array, for graphs whose largest degree fits a row."""
    return graph.arcs().groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "eid", "v", "w"))), lambda x: F.struct(x["v"], x["w"])).alias("neighbors"))


def dense(graph: Graph) -> DataFrame:
    """(u, v, w) for every pair of vertices, 0.0 where there is no edge. There are n * n rows, so graphs of more than MOST_DENSE
    vertices raise."""
    n = graph.n
    if n > MOST_DENSE:
        raise InvalidArgument(f"{n} vertices are too many for a matrix")
    cells = graph.spark.range(n * n).select((F.col("id") / n).cast("long").alias("u"), (F.col("id") % n).alias("v"))
    return weights_of(graph, cells)
