"""Breadth-first and depth-first traversals with exact visit order, parents and distances; paths.

A traversal has a row per vertex: (v, dist, parent, ord), -1 for what wasn't reached, parent -1 for the source.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..plans import loops
from ..plans.loops import Dealt, cut, kept, with_ordinal
from ..plans.model import Graph

SCHEMA = "v long, dist int, parent long, ord long"
#: Up to so many arcs one task walks the graph (some 100 MB); beyond, each level is a join. Both give the same rows.
SMALL_ARCS = 2_000_000


def bfs(graph: Graph, source: int, small: int = SMALL_ARCS) -> DataFrame:
    """Breadth-first search over successors in the policy's order, as a queue would have it; weights don't matter."""
    _source(graph, source)
    graph = graph.kept()
    arcs = graph.arcs()
    if small and graph.edges.limit(small + 1).count() <= small and arcs.count() <= small:
        return complete(graph, in_one_task(arcs, lambda a: walk_levels(a, source)))
    return complete(graph, levels(arcs, source, graph.n))


def _source(graph: Graph, source: int) -> None:
    if not 0 <= source < graph.n:
        raise InvalidArgument(f"source {source}")


def complete(graph: Graph, reached: DataFrame) -> DataFrame:
    """All vertices, -1 for those that aren't reached."""
    full = graph.vertices.withColumnRenamed("id", "v").join(reached, "v", "left")
    return full.select("v", *(F.coalesce(c, F.lit(-1)).cast(t).alias(c) for c, t in (("dist", "int"), ("parent", "long"), ("ord", "long"))))


def levels(arcs: DataFrame, source: int, n: int) -> DataFrame:
    """A join for each level. A vertex is found by the least (ord of u, pos) among the arcs that lead to it, and a level's
    vertices follow one another in that order: that is what a queue does, so order and parents are exact. Of n vertices."""
    spark = arcs.sparkSession
    arcs = Dealt(arcs.select("u", "v", "pos"), "u")
    reached = frontier = kept(spark.createDataFrame([(source, 0, -1, 0)], SCHEMA))
    count = new = 1
    level = 0
    while new and count < n:
        level += 1
        met = _met(arcs, frontier.select(F.col("v").alias("u"), F.col("ord").alias("from")), new, reached, count, n)
        # both in one number, so that minima are hashed: rows would be sorted
        key = F.col("from").cast("decimal(20,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + (F.col("pos").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)"))
        best = met.select("v", "u", key.alias("first")).groupBy("v").agg(F.min("first").alias("first"), F.min_by("u", "first").alias("parent"))
        placed = kept(with_ordinal(best.join(reached.select("v"), "v", "left_anti"), "place", "first").select("v", F.lit(level).alias("dist"), "parent", (F.col("place") + count).alias("ord")))
        new = placed.count()
        count += new
        frontier, reached = placed, kept(reached.unionByName(placed)) if level % 8 == 0 else reached.unionByName(placed)
    return reached


def _met(arcs: Dealt, frontier: DataFrame, new: int, reached: DataFrame, count: int, n: int) -> DataFrame:
    """The arcs out of a frontier of so many vertices, with its columns, as far as they may lead to one of those left. Where few vertices are left
    but many are in the frontier, other arcs are dropped first."""
    if new <= loops.FEW or n - count > loops.FEW:
        return arcs.joined(frontier, new)
    rest = kept(arcs.rows.sparkSession.range(n).toDF("v").join(reached.select("v"), "v", "left_anti"))
    return frontier.join(arcs.rows.join(F.broadcast(rest), "v"), "u")


def distances(graph: Graph, source: int) -> DataFrame:
    """(v, dist) alone: levels need no order, so nothing is ranged or numbered."""
    _source(graph, source)
    graph = graph.kept()
    arcs = Dealt(graph.arcs().select("u", "v"), "u")
    reached = frontier = kept(graph.spark.createDataFrame([(source, 0)], "v long, dist int"))
    count = new = 1
    level = 0
    while new and count < graph.n:
        level += 1
        found = _met(arcs, frontier.select(F.col("v").alias("u")), new, reached, count, graph.n).select("v").distinct().join(reached.select("v"), "v", "left_anti")
        frontier = kept(found.withColumn("dist", F.lit(level)))
        new = frontier.count()
        count += new
        reached = reached.unionByName(frontier)
        if level % 8 == 0:
            reached = kept(reached)
    return graph.vertices.withColumnRenamed("id", "v").join(reached, "v", "left").select("v", F.coalesce("dist", F.lit(-1)).alias("dist"))


class Adjacency:
    """Arcs of one task: heads of blocks and successors in order."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        columns = [[b.column(k).to_numpy() for k in range(4)] for b in batches if b.num_rows]
        none = np.empty(0, np.int64)
        u, v, pos, eid = (np.concatenate([none, *(c[k] for c in columns)]) for k in range(4))
        order = np.lexsort((eid, pos, u))
        u, self.to = u[order], v[order].tolist()
        names, heads = np.unique(u, return_index=True)
        self.blocks = dict(zip(names.tolist(), zip(heads.tolist(), [*heads[1:].tolist(), len(u)], strict=True), strict=True))

    def successors(self, u: int) -> list[int]:
        start, end = self.blocks.get(u, (0, 0))
        return self.to[start:end]


def walk_levels(adjacency: Adjacency, source: int) -> Iterator[tuple[int, int, int]]:
    dist, queue = {source: 0}, deque([source])
    yield source, 0, -1
    while queue:
        u = queue.popleft()
        for v in adjacency.successors(u):
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
                yield v, dist[v], u


def packed(batches: Iterator[pa.RecordBatch], names: int) -> tuple[np.ndarray, np.ndarray]:
    """(head, to): the arcs (place, u, v) of vertices below names, put at their places, and where each vertex' arcs begin and end. Places follow u."""
    kind = np.int32 if names < 1 << 31 else np.int64
    counts, to = np.zeros(names + 1, np.int64), np.empty(1 << 20, kind)
    for b in batches:
        if b.num_rows:
            place, u, v = (b.column(k).to_numpy() for k in range(3))
            if (most := int(place.max()) + 1) > len(to):
                to.resize(max(most, len(to) * 5 // 4), refcheck=False)
            to[place] = v
            named, times = np.unique(u, return_counts=True)
            counts[named + 1] += times
    return np.cumsum(counts, out=counts), to


def walk_depths(head: np.ndarray, to: np.ndarray, source: int) -> tuple[np.ndarray, ...]:
    """(v, dist, parent) in preorder. Besides the arcs it holds some 40 bytes a vertex."""
    n = len(head) - 1
    seen, at = np.zeros(n, np.bool_), head[:-1].copy()
    found = [array("q", [source]), array("q", [0]), array("q", [-1])]
    stack = array("q", [source])
    seen[source] = True
    while stack:
        u = stack[-1]
        k, end, width = int(at[u]), int(head[u + 1]), 16
        v = -1
        while k < end:
            block = to[k : min(k + width, end)]
            free = ~seen[block]
            first = int(free.argmax())
            if free[first]:
                v, k = int(block[first]), k + first + 1
                break
            k, width = k + len(block), min(width * 4, 1 << 16)
        at[u] = k
        if v < 0:
            stack.pop()
            continue
        seen[v] = True
        for column, x in zip(found, (v, len(stack), u), strict=True):
            column.append(x)
        stack.append(v)
    return tuple(np.frombuffer(c, np.int64) for c in found)


def in_one_task(arcs: DataFrame, walk: Callable[[Adjacency], Iterator[tuple[int, int, int]]]) -> DataFrame:
    """What walk gives, numbered, from all arcs in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(walk(Adjacency(batches)))
        for at in range(0, len(rows), 1 << 16):
            v, dist, parent = zip(*rows[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(dist, pa.int32()), pa.array(parent, pa.int64()), pa.array(range(at, at + len(v)), pa.int64())], names=["v", "dist", "parent", "ord"])

    return arcs.select("u", "v", "pos", "eid").repartition(1).mapInArrow(run, SCHEMA)


def dfs(graph: Graph, source: int) -> DataFrame:
    """Depth-first search in preorder, into the first undiscovered successor in the policy's order; dist is the depth in
    the tree. Lexicographic depth-first search is inherently sequential: one task holds the arcs that the source reaches, 4 bytes each, and some 60 bytes
    for each vertex. Arcs are ordered by all tasks beforehand."""
    _source(graph, source)
    graph = graph.kept()
    arcs, n = graph.arcs(), graph.n
    if graph.edges.limit(SMALL_ARCS + 1).count() > SMALL_ARCS // 2:
        reach = distances(graph, source).where("dist >= 0").select(F.col("v").alias("u"))
        arcs = arcs.join(reach, "u", "left_semi")
    arcs = with_ordinal(arcs.select("u", "v", "pos", "eid"), "place", "u", "pos", "eid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = walk_depths(*packed(batches, n), source)
        for at in range(0, len(columns[0]), 1 << 16):
            v, dist, parent = (c[at : at + (1 << 16)] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(dist, pa.int32()), pa.array(parent), pa.array(np.arange(at, at + len(v)))], names=["v", "dist", "parent", "ord"])

    return complete(graph, arcs.select("place", "u", "v").repartition(1).mapInArrow(run, SCHEMA))


def reached_count(traversal: DataFrame) -> DataFrame:
    return traversal.agg(F.count_if(F.col("dist") >= 0).alias("reached"))


def paths(traversal: DataFrame) -> DataFrame:
    """(v, path) with path `source -> ... -> v` for every reached vertex.

    Parents are doubled: a round joins each vertex's path so far with that of the path's first vertex, so a path of length d
    takes log2(d) rounds.
    """
    reached = traversal.where("dist >= 0")
    current = cut(reached.select("v", F.when(F.col("parent") >= 0, F.col("parent")).alias("up"), F.array("v").alias("path")))
    while not current.where("up is not null").isEmpty():
        upper = current.select(F.col("v").alias("_v"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = current.join(upper, F.col("up") == F.col("_v"), "left")
        current = cut(joined.select("v", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
    return current.select("v", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("path"))
