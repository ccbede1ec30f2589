"""Edges by weight, least keys, and minimum spanning forests.

The order is total: by weight, NaN last, and then by eid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..plans.loops import kept, with_ordinal
from ..plans.model import Graph
from ..plans.stars import stars

#: Up to so many edges one task builds the forest; beyond, rounds of joins do. Both give the same edges.
SMALL_EDGES = 1_000_000
#: Edges that a task holds when it thins them out.
CHUNK = 1 << 22


def sort_edges(edges: DataFrame) -> DataFrame:
    """edges with rank, from 0, by (w, eid): a range-partitioned sort."""
    return with_ordinal(edges, "rank", "w", "eid")


def sort_range(edges: DataFrame, p: int, q: int) -> DataFrame:
    """edges with rank: places p to q (both included, in eid order) sorted by weight, all others where they were."""
    count = edges.count()
    if p < 0 or q >= count:
        raise InvalidArgument(f"range {p}..{q} of {count} edges")
    placed = with_ordinal(edges, "rank", "eid")
    inside = with_ordinal(placed.where(F.col("rank").between(p, q)).drop("rank"), "rank", "w", "eid")
    return placed.where(~F.col("rank").between(p, q)).unionByName(inside.withColumn("rank", F.col("rank") + p))


def least_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k least edges with their rank: each task keeps k rows."""
    least = edges.orderBy("w", "eid").limit(k)
    return least.withColumn("rank", F.row_number().over(W.orderBy("w", "eid")).cast("long") - 1)


def extract_min(keys: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(the k least keys, those that are left) of keys(k)."""
    least = keys.orderBy("k").limit(k)
    return least, keys.join(least, "k", "left_anti")


def insert_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """keys with new ones; negative and present ones raise, as do repeated ones."""
    both = keys.unionByName(new)
    row = both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("d"), F.count_if(F.coalesce(F.col("k") < 0, F.lit(True))).alias("bad")).first()
    if row.bad or row.n != row.d:
        raise InvalidArgument("negative or repeated key")
    return both


def decrease_key(keys: DataFrame, key: int, delta: int) -> DataFrame:
    """keys with key - delta for key; absent keys, negative arguments or results and collisions raise."""
    new = key - delta
    row = keys.agg(F.count_if(F.col("k") == key).alias("there"), F.count_if(F.col("k") == new).alias("taken")).first()
    if key < 0 or delta < 0 or new < 0 or not row.there or (delta and row.taken):
        raise InvalidArgument(f"key {key}, delta {delta}")
    return keys.select(F.when(F.col("k") == key, new).otherwise(F.col("k")).cast("long").alias("k"))


def minimum_spanning_forest(graph: Graph, small: int = SMALL_EDGES) -> DataFrame:
    """Edges of the minimum spanning forest; it is unique under the total order, so Kruskal's, Prim's and Boruvka's agree."""
    if graph.directed:
        raise InvalidArgument("spanning forests are for undirected graphs")
    edges = kept(graph.edges.where("src <> dst").select("eid", "src", "dst", "w"))
    edges = thinned(edges, small)
    return _kruskal(edges) if edges.count() <= small else _boruvka(edges, small)


def _kruskal(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        for b in batches:  # in order
            keep = []
            for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                s, d = root(s), root(d)
                keep.append(s != d)
                up[s] = d
            yield b.filter(pa.array(keep))

    ordered = edges.select("eid", "src", "dst", "w").where("src <> dst").repartition(1).sortWithinPartitions("w", "eid")
    return ordered.mapInArrow(run, "eid long, src long, dst long, w double")


def local_forest(src: np.ndarray, dst: np.ndarray, w: np.ndarray, eid: np.ndarray) -> np.ndarray:
    """Places of the minimum spanning forest's edges, by Boruvka's rounds on arrays. No edge is a loop."""
    ranked = np.lexsort((eid, w))
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    x, y, at = ends[: len(src)][ranked], ends[len(src) :][ranked], ranked
    picked = [np.empty(0, np.int64)]
    while len(at):
        place = np.arange(len(at))
        best, other = (np.full(len(nodes), len(at)) for _ in range(2))
        best[x[::-1]], other[y[::-1]] = place[::-1], place[::-1]  # of repeated indices the last is assigned: the least edge
        best = np.minimum(best, other)
        c = np.flatnonzero(best < len(at))
        least = best[c]
        picked.append(at[np.unique(least)])
        to = x[least] + y[least] - c
        root = np.arange(len(nodes))
        root[c] = to
        # two components that took the same edge point at each other: the lesser becomes the root
        lesser = c[(root[to] == c) & (c < to)]
        root[lesser] = lesser
        while not ((up := root[root]) == root).all():
            root = up
        x, y = root[x], root[y]
        differ = x != y
        x, y, at = x[differ], y[differ], at[differ]
    return np.concatenate(picked)


def forests(edges: DataFrame) -> DataFrame:
    """Each task's edges without those that close a cycle in it as the last of the total order: no spanning forest of the whole has them. A task holds
    some CHUNK edges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def least() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            picked = local_forest(*(table.column(k).to_numpy() for k in ("src", "dst", "w", "eid")))
            return table.take(pa.array(picked)).combine_chunks().to_batches()[0] if len(picked) else held[0].slice(0, 0)

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK:
                forest = least()
                held.clear()
                if forest.num_rows > CHUNK // 2:
                    yield forest
                else:
                    held.append(forest)
                count = sum(x.num_rows for x in held)
        if held:
            yield least()

    return edges.mapInArrow(run, "eid long, src long, dst long, w double")


def thinned(edges: DataFrame, small: int) -> DataFrame:
    """Stored edges with the same minimum spanning forest, in rounds of `forests` over ranges of sources, as long as a round leaves at most half."""
    count = edges.count()
    while count > small:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism if count > CHUNK else 1, -(-2 * count // CHUNK))
        fewer = kept(forests(edges.repartitionByRange(tasks, "src", "eid")))
        before, count, edges = count, fewer.count(), fewer
        if 2 * count > before:
            break
    return edges


def _boruvka(edges: DataFrame, small: int) -> DataFrame:
    """Each round every component takes its least outgoing edge; at most log2(n) rounds. Edges are ranked once, so that rounds compare whole
    numbers; one task finishes when few edges between components are left."""
    edges = kept(with_ordinal(edges, "rank", "w", "eid"))
    live = edges.select("rank", F.col("src").alias("a"), F.col("dst").alias("b"))
    count, picked = edges.count(), []
    while count:
        if count <= small:
            rest = live.select(F.col("rank").alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("rank").cast("double").alias("w"))
            picked.append(_kruskal(rest).select(F.col("eid").alias("rank")))
            break
        sides = live.select(F.col("a").alias("c"), F.col("b").alias("to"), "rank").unionByName(live.select(F.col("b").alias("c"), F.col("a").alias("to"), "rank"))
        best = kept(sides.groupBy("c").agg(F.min("rank").alias("rank"), F.min_by("to", "rank").alias("to")))
        picked.append(best.select("rank").distinct())
        of = stars(best.select(F.col("c").alias("a"), F.col("to").alias("b")), keep=kept).toDF("v", "root")
        for end in ("a", "b"):
            live = live.join(of.withColumnRenamed("v", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        live = kept(live.where("a <> b").select("rank", "a", "b"))
        count = live.count()
    if not picked:
        return edges.select("eid", "src", "dst", "w")
    chosen = kept(reduce(DataFrame.unionByName, picked))
    return edges.join(chosen, "rank", "left_semi").select("eid", "src", "dst", "w")


def prim(graph: Graph, start: int) -> DataFrame:
    """The tree of the start's component: the forest's edges that are connected to the start."""
    if not 0 <= start < graph.n:
        raise InvalidArgument(f"vertex {start}")
    forest = kept(minimum_spanning_forest(graph))
    # by stars, as a tree may be very deep
    of = stars(forest.select(F.col("src").alias("a"), F.col("dst").alias("b")), keep=kept)
    row = of.where(F.col("a") == start).first()
    root = start if row is None else row.b
    inside = of.where(F.col("b") == root).select(F.col("a").alias("src"))
    return forest.where(F.col("src") == root).unionByName(forest.join(inside, "src", "left_semi").select(*forest.columns)).select("eid", "src", "dst", "w")
