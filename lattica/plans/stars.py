"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014).

No node's neighbours are ever gathered: minima are partial aggregates, joined back to the edges. They are dealt anew before
the join, so that adaptive execution may split a node that has very many edges. Each round is kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loops import cut

#: Edges that a task turns into stars at once.
CHUNK = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) for the edges a-b of one task, by hooking and pointer jumping on arrays."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the components of edges(a long, b long): what a task holds, CHUNK at a time, becomes stars, so that chains
    get short before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
            held.clear()
            nodes, roots = local_roots(a, b)
            others = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[others]), pa.array(roots[others])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large: each node's larger neighbours go to the least of it and its neighbours. Small: each node and
    its lesser neighbours go to the least of those."""
    arcs = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges
    arcs = arcs.toDF("u", "v")
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = arcs.join(least.repartition(partitions), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def stars(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(a, b) for every node a of edges(a long, b long) but the least of each component, which is b. edges are read once; `keep`
    computes a round and gives what later rounds read."""
    current = keep(contracted(edges))
    before = None
    while True:
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (now.n, now.h) == before or now.n == 0:
            return current
        before = (now.n, now.h)
        current = keep(star(star(current, True), False))
