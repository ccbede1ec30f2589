"""Graphs in the star-schema tables. Edge ids are composed from keys, so that nothing is sorted to number edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.loops import with_ordinal
from ..plans.model import Graph

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """The directed tree region, nation, customer and nation, supplier."""
    nation, customer, supplier = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    c, s = customer.count(), supplier.count()
    edges = (
        nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 5).cast("long").alias("dst"))
        .unionByName(customer.select((F.col("c_nationkey") + 5).cast("long").alias("src"), (F.col("c_custkey") + 30).alias("dst")))
        .unionByName(supplier.select((F.col("s_nationkey") + 5).cast("long").alias("src"), (F.col("s_suppkey") + 30 + c).alias("dst")))
    )
    return Graph.from_edges(edges.select(F.col("dst").alias("eid"), "src", "dst", F.lit(1.0).alias("w")), 30 + c + s, True, "star", check=False)


def trade(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Customers and suppliers, an edge for each pair that traded, weighted by revenue."""
    orders, lineitem = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    c, s = read(spark, sf_dir, "customer").count(), read(spark, sf_dir, "supplier").count()
    sums = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_extendedprice").join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("w"))
    edges = sums.select((F.col("o_custkey") * s + F.col("l_suppkey")).alias("eid"), F.col("o_custkey").alias("src"), (F.col("l_suppkey") + c).alias("dst"), "w")
    return Graph.from_edges(edges, c + s, directed, "star", check=False)


def part_operations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A log of adds and, for returned items, removes over parts and suppliers; and the number of vertices."""
    p, s = read(spark, sf_dir, "part").count(), read(spark, sf_dir, "supplier").count()
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    items = with_ordinal(items, "seq", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "R", "remove").otherwise("add")
    return items.select("seq", kind.alias("kind"), F.col("l_partkey").alias("u"), (F.col("l_suppkey") + p).alias("v"), F.col("l_quantity").alias("w")), p + s


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order to the customer's next one."""
    orders = read(spark, sf_dir, "orders")
    following = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("src"), following.alias("dst")).where("dst is not null")
    n = orders.agg(F.max("o_orderkey")).first()[0] + 1
    return Graph.from_edges(edges.select(F.col("src").alias("eid"), "src", "dst", F.lit(1.0).alias("w")), n, True, "star", check=False)


def event_transitions(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """How often a user's event of one type follows one of another; undirected: both ways added up, without loops."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).alias("k"))
    following = F.lead("k").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = events.select((F.col("k") - 1).alias("src"), (following - 1).alias("dst")).where("dst is not null")
    if not directed:
        steps = steps.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    counted = steps.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return Graph.from_edges(counted.select((F.col("src") * 5 + F.col("dst")).alias("eid"), "src", "dst", "w"), 5, directed, "star", check=False)


def conversation_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each turn to the next one of its conversation."""
    turns = with_ordinal(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "id", "conv_id", "turn")
    edges = turns.select(F.col("id").alias("src"), F.lead("id").over(W.partitionBy("conv_id").orderBy("turn")).alias("dst")).where("dst is not null")
    return Graph.from_edges(edges.select(F.col("src").alias("eid"), "src", "dst", F.lit(1.0).alias("w")), turns.count(), True, "star", check=False)
