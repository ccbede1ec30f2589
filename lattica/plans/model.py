"""The graph: a plan for its edges, the number of vertices, a direction and a representation policy.

Policies decide what an edge table means and in which order neighbours come:

* ``star``: immutable; parallel edges stay; neighbours in edge order.
* ``list``: one edge per pair, last weight wins; the most recently created edge comes first.
* ``matrix``: one edge per pair; neighbours by vertex number.

Edges are rows (eid, src, dst, w); eid orders them. Arcs are rows (u, v, w, eid, pos): both directions of an undirected edge,
a self-loop once; pos orders the arcs out of u. Every operator works on arcs, whatever the policy.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ImmutableGraph, InvalidArgument
from .loops import ensure_checkpoint_dir, kept, tasks_for

EDGES = "eid long, src long, dst long, w double"
OPERATIONS = "seq long, kind string, u long, v long, w double"
POLICIES = ("star", "list", "matrix")


def check_edges(edges: DataFrame, n: int) -> DataFrame:
    """One row: edges, and edges that aren't valid (a null, a vertex out of range, weight zero)."""
    valid = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1) & (F.col("w") != 0.0)
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))


def pair(directed: bool) -> list[Column]:
    """The key by which mutable representations tell edges apart."""
    if directed:
        return [F.col("u").alias("src"), F.col("v").alias("dst")]
    return [F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")]


def canonical(operations: DataFrame, directed: bool) -> DataFrame:
    """Edges that stand after a log of adds and removes: an edge lives since its pair's last removal, is as old as the first
    add after it and has the weight of the last one. One shuffle by pair; a pair's history is sorted in one task, and
    spills there if it must.
    """
    keyed = operations.select("seq", "kind", *pair(directed), "w")
    keyed = keyed.repartition(tasks_for(keyed), "src", "dst")
    removed = F.coalesce(F.max(F.when(F.col("kind") == "remove", F.col("seq"))).over(W.partitionBy("src", "dst")), F.lit(-1))
    live = keyed.withColumn("_removed", removed).where((F.col("kind") == "add") & (F.col("seq") > F.col("_removed")))
    return live.groupBy("src", "dst").agg(F.min("seq").alias("eid"), F.max_by("w", "seq").alias("w")).select("eid", "src", "dst", "w")


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n: int
    directed: bool
    policy: str
    folder: str | None = None
    at_hand: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @staticmethod
    def create(spark: SparkSession, n: int, directed: bool, policy: str = "list") -> Graph:
        """A graph without edges, of a mutable policy."""
        if n <= 0 or policy not in POLICIES:
            raise InvalidArgument(f"n={n}, policy={policy}")
        if policy == "star":
            raise InvalidArgument("a star graph is made from its edges")
        return Graph(spark.createDataFrame([], EDGES), n, directed, policy)

    @staticmethod
    def from_edges(edges: DataFrame, n: int, directed: bool, policy: str = "star", check: bool = True) -> Graph:
        """All edges or none: a single invalid one raises. Mutable policies take the edges as adds in eid order."""
        if n <= 0 or policy not in POLICIES:
            raise InvalidArgument(f"n={n}, policy={policy}")
        edges = edges.select(F.col("eid").cast("long"), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double"))
        if check and (bad := check_edges(edges, n).first().invalid):
            raise InvalidArgument(f"{bad} invalid edges")
        graph = Graph(edges, n, directed, "star")
        return graph if policy == "star" else graph.with_policy(policy)

    @staticmethod
    def from_operations(operations: DataFrame, n: int, directed: bool, policy: str = "list", check: bool = True) -> Graph:
        """A mutable graph from a log (seq, kind, u, v, w) of adds and removes."""
        if policy == "star":
            raise ImmutableGraph("star")
        if check:
            ends = F.col("u").between(0, n - 1) & F.col("v").between(0, n - 1)
            valid = ends & ((F.col("kind") == "remove") | ((F.col("kind") == "add") & (F.col("w") != 0.0)))
            if operations.where(~F.coalesce(valid, F.lit(False))).limit(1).count():
                raise InvalidArgument("invalid operations")
        return Graph(canonical(operations, directed), n, directed, policy)

    def with_policy(self, policy: str) -> Graph:
        """The same edges under another policy; from star, later parallel edges are upserts."""
        if policy not in POLICIES:
            raise InvalidArgument(policy)
        if self.policy != "star" or policy == "star":
            return Graph(self.edges, self.n, self.directed, policy)
        adds = self.edges.select(F.col("eid").alias("seq"), F.col("src").alias("u"), F.col("dst").alias("v"), "w")
        keyed = adds.select("seq", *pair(self.directed), "w")
        # dealt before they are grouped: a map task's partial sums would hold nearly all of its rows
        merged = keyed.repartition(tasks_for(keyed), "src", "dst").groupBy("src", "dst").agg(F.min("seq").alias("eid"), F.max_by("w", "seq").alias("w"))
        return Graph(merged.select("eid", "src", "dst", "w"), self.n, self.directed, policy)

    def _mutable(self, u: int, v: int, w: float = 1.0) -> None:
        # what is wrong with the arguments is told before what is wrong with the graph
        if not (0 <= u < self.n and 0 <= v < self.n) or w == 0.0:
            raise InvalidArgument(f"({u}, {v}, {w})")
        if self.policy == "star":
            raise ImmutableGraph("star")

    def apply(self, operations: DataFrame) -> Graph:
        """The graph after further operations; their seq must lie beyond every eid."""
        self._mutable(0, 0)
        adds = self.edges.select(F.col("eid").alias("seq"), F.lit("add").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "w")
        return Graph.from_operations(adds.unionByName(operations), self.n, self.directed, self.policy)

    def _next(self) -> int:
        last = self.edges.agg(F.max("eid")).first()[0]
        return 0 if last is None else last + 1

    def add_edge(self, u: int, v: int, w: float) -> Graph:
        self._mutable(u, v, w)
        return self.apply(self.spark.createDataFrame([(self._next(), "add", u, v, float(w))], OPERATIONS))

    def remove_edge(self, u: int, v: int) -> Graph:
        """Without the edge; an absent one is no error."""
        self._mutable(u, v)
        return self.apply(self.spark.createDataFrame([(self._next(), "remove", u, v, None)], OPERATIONS))

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    def arcs(self) -> DataFrame:
        """(u, v, w, eid, pos)."""
        out = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w", "eid")
        if not self.directed:
            out = out.unionByName(self.edges.where("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), "w", "eid"))
        position = {"star": F.col("eid"), "list": -F.col("eid"), "matrix": F.col("v")}[self.policy]
        return out.withColumn("pos", position)

    def arcs_in(self) -> DataFrame:
        """(u, v, w, eid, pos) with pos the order of predecessors u of v."""
        arcs = self.arcs()
        if not self.directed:  # the arcs out of v, read backwards
            return arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "eid", "pos")
        return arcs.withColumn("pos", F.col("eid") if self.policy == "star" else F.col("u"))

    def count_edges(self) -> int:
        return self.edges.count()

    def stored(self) -> Graph:
        """The same graph with its edges in one table, dealt and sorted by source: lookups and scans from a source read few row groups, and nothing is
        derived again. `free` removes the table."""
        ensure_checkpoint_dir(self.spark)
        folder = f"{self.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graph-{uuid.uuid4().hex}"
        self.edges.repartition("src").sortWithinPartitions("src", "eid").write.parquet(folder)
        return replace(self, edges=self.spark.read.schema(EDGES).parquet(folder), folder=folder)

    def kept(self) -> Graph:
        """The same graph with its edges in a table, as they come: what reads them often derives them once."""
        return self if self.folder or self.at_hand else replace(self, edges=kept(self.edges), at_hand=True)

    def free(self) -> None:
        """Gives up what the graph holds: its cached edges, and its table if it is a stored one. It can't be read then."""
        self.edges.unpersist()
        if self.folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
