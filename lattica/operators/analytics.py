"""Extensions: components, shortest paths, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..plans.loops import Dealt, kept
from ..plans.model import Graph
from ..plans.stars import stars


def components(graph: Graph) -> DataFrame:
    """(v, component): the least vertex connected to v, directions aside."""
    least = stars(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.withColumnRenamed("id", "v").join(least.toDF("v", "least"), "v", "left").select("v", F.coalesce("least", "v").alias("component"))


def shortest_paths(graph: Graph, source: int) -> DataFrame:
    """(v, distance) by weights, null if unreached. Only vertices whose distance fell relax their arcs; a round beyond n - 1
    that still lowers one means a negative cycle and raises."""
    if not 0 <= source < graph.n:
        raise InvalidArgument(f"source {source}")
    graph = graph.kept()
    arcs = Dealt(graph.arcs().select("u", "v", "w"), "u")
    known = fallen = kept(graph.spark.createDataFrame([(source, 0.0)], "v long, distance double"))
    count = 1
    for _ in range(graph.n):
        offers = arcs.joined(fallen.withColumnRenamed("v", "u"), count).groupBy("v").agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        merged = kept(known.join(offers, "v", "full").select("v", F.least("distance", "offer").alias("distance"), (F.col("offer") < F.coalesce("distance", F.lit(float("inf")))).alias("fell")))
        known, fallen = merged.select("v", "distance"), merged.where("fell").select("v", "distance")
        count = fallen.count()
        if not count:
            return graph.vertices.withColumnRenamed("id", "v").join(known, "v", "left")
    raise InvalidArgument("negative cycle")


def pagerank(graph: Graph, rounds: int, damping: float = 0.85) -> DataFrame:
    """(v, rank) after so many rounds from 1 / n: a vertex passes its rank on over its arcs in equal parts; what vertices
    without arcs hold is spread over all."""
    graph = graph.kept()
    arcs = Dealt(graph.arcs().select("u", "v"), "u")
    degree = arcs.rows.groupBy("u").agg(F.count(F.lit(1)).alias("out"))
    ranks = kept(graph.vertices.select(F.col("id").alias("v"), F.lit(1.0 / graph.n).alias("rank")).join(degree.withColumnRenamed("u", "v"), "v", "left"))
    for _ in range(rounds):
        stuck = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        parts = ranks.where("out is not null").select(F.col("v").alias("u"), (F.col("rank") / F.col("out")).alias("part"))
        passed = arcs.joined(parts, graph.n).groupBy("v").agg(F.sum("part").alias("got"))
        base = (1 - damping) / graph.n + damping * stuck / graph.n
        ranks = kept(ranks.select("v", "out").join(passed, "v", "left").select("v", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "out"))
    return ranks.select("v", "rank")
