"""Cutting lineage in loops, and ordinals without a single-task sort."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the reliable checkpoint folder from here on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read from Parquet in the checkpoint folder from here on. Unlike `cut`, plans over it take nothing of df's plan
    along: over many rounds of joins the constraints that a checkpoint inherits grow until the driver has no memory left."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Bytes of a plan's input, as Spark estimates them, for a task that sorts or groups them; some million narrow rows in Parquet.
TASK_BYTES = 12 << 20
MOST_TASKS = 10_000


def tasks_for(df: DataFrame) -> int:
    """So many tasks that what each sorts or groups of df stays the same as df grows; spark.sql.shuffle.partitions at least, also where Spark
    knows no size."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    # of a join Spark takes the product
    size = min(int(plan.stats().sizeInBytes()), sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 50 else max(least, min(size // TASK_BYTES, MOST_TASKS))


def with_ordinal(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its place, from 0, in a total order. Rows are ranged by the order and sorted, and numbered as they are stored; only the ranges'
    sizes, one number a task, go through the driver."""
    ranged = df.repartitionByRange(tasks_for(df), *order).sortWithinPartitions(*order)
    # the number of the task above 33 bits, that of the row in it below
    stored = kept(ranged.withColumn("_at", F.monotonically_increasing_id()))
    sizes = dict(stored.groupBy(F.shiftright("_at", 33).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    base, bases = 0, []
    for k in range(max(sizes, default=0) + 1):
        bases.append(f"{base}L")
        base += sizes.get(k, 0)
    first = F.get(F.expr(f"array({', '.join(bases)})"), F.shiftright("_at", 33).cast("int"))
    return stored.withColumn(name, first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def cut_by(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """As cut, dealt by columns: joins and aggregations on them don't shuffle df again. Adaptive plans hide how they are
    dealt, so this one is planned without."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(tasks, *columns))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: A key of more rows than this, and of more than one in HUBS of all rows, is a hub: there are at most HUBS of them.
HUB_ROWS = 100_000
HUBS = 1024


#: Up to so many rows are broadcast to a table that loops join.
FEW = 1_000_000
#: Rows of such a table for a task that joins them.
TASK_ROWS = 1_000_000


class Dealt:
    """A table that loops join by one column, round after round. Few rows are broadcast to it, as it is; it is dealt by the column, once, when a
    round has more. Rows of hubs aren't dealt, as one task would hold them: they stay spread, and what is joined to them, a row a hub at
    most, is broadcast."""

    def __init__(self, df: DataFrame, key: str, hub_rows: int = HUB_ROWS):
        """df is read often: a stored table, or projections of one."""
        self.key, self.rows, self.hub_rows = key, df, hub_rows

    @cached_property
    def count(self) -> int:
        return self.rows.count()

    @cached_property
    def hubs(self) -> list:
        if self.count <= self.hub_rows:
            return []
        large = self.rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(self.hub_rows, self.count // HUBS))
        return [r[self.key] for r in large.select(self.key).collect()]

    @cached_property
    def tasks(self) -> int:
        return max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.count // TASK_ROWS))

    @cached_property
    def light(self) -> DataFrame:
        return cut_by(self.rows.where(~F.col(self.key).isin(self.hubs)) if self.hubs else self.rows, self.tasks, self.key)

    @cached_property
    def heavy(self) -> DataFrame | None:
        return kept(self.rows.where(F.col(self.key).isin(self.hubs)).repartition(self.tasks)) if self.hubs else None

    def joined(self, other: DataFrame, count: int | None = None) -> DataFrame:
        """other, which has a row a key at most, with the rows of its keys; count: of other's rows, if it is known."""
        if count is not None and count <= FEW:
            return F.broadcast(other).join(self.rows, self.key)
        out = other.hint("shuffle_hash").join(self.light, self.key)
        if self.heavy is not None:
            few = other.where(F.col(self.key).isin(self.hubs))
            out = out.unionByName(F.broadcast(few).join(self.heavy, self.key))
        return out


def with_rank(df: DataFrame, name: str, group: str, *order: str) -> DataFrame:
    """df with its place, from 0, in a total order among the rows of its group, a long. Rows are ranged by group and order, so a large group
    is split over tasks; three numbers a range go through the driver and back."""
    ranged = cut(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.groupBy("_range").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by("_n", group).alias("n"))
    last, before, bases = None, 0, []
    for r in sorted(ends.collect()):
        if r["first"] == last:
            bases.append((r["_range"], last, before))
        before = r["n"] + (before if r["first"] == last == r["last"] else 0)
        last = r["last"]
    inside = F.row_number().over(W.partitionBy("_range", group).orderBy(*order)) - 1
    placed = ranged.withColumn("_place", inside)
    offsets = df.sparkSession.createDataFrame(bases, f"_range int, {group} long, _base long")
    return placed.join(F.broadcast(offsets), ["_range", group], "left").withColumn(name, F.col("_place") + F.coalesce("_base", F.lit(0).cast("long"))).drop("_range", "_place", "_base")
