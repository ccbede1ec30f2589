"""Graphviz DOT text: edge lists in, highlighted drawings out."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.text import general_format
from ..plans.loops import kept, tasks_for
from ..plans.model import Graph

MOST_CHARS = 1023
MOST_ID = 2**31 - 1
BLANKS = "^[ \\t\\n\\x0B\\f\\r]+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a file, or of several in the order of their paths, from 0. Blocks of a file are read by tasks of their own; lines are numbered
    within their block as they are stored, and a row a block goes through the driver."""
    try:
        text = spark.read.text(path, lineSep="\n")
    except AnalysisException as e:
        raise InvalidArgument(f"{path} can't be read") from e
    lines = text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    stored = kept(lines)
    blocks = stored.groupBy("_file", "_start").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    base, bases = 0, []
    for r in sorted(blocks, key=lambda r: (r["_file"], r["_start"])):
        bases.append((r["_file"], r["_start"], base - r["first"]))
        base += r["n"]
    shifts = spark.createDataFrame(bases, "_file string, _start long, _shift long")
    return stored.join(F.broadcast(shifts), ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One file at path, which all share, from lines(line_no, line) in the order of their numbers: tasks sort and write parts, which are
    then put one behind the other as bytes."""
    spark = lines.sparkSession
    lines.repartitionByRange(tasks_for(lines), "line_no").sortWithinPartitions("line_no").select("line").write.text(f"{path}.parts", lineSep="\n")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder = hadoop.fs.Path(f"{path}.parts")
    fs = folder.getFileSystem(conf)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    out = fs.create(hadoop.fs.Path(path), True)
    try:
        for part in parts:
            source = fs.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        out.close()
    fs.delete(folder, True)


def parsed(lines: DataFrame, truncate: bool = True) -> DataFrame:
    """Per line that counts: header (true: directed), or its ids up to the first that is too large and its arc operator."""
    blank = lambda c: F.regexp_replace(c, BLANKS, "")
    line = blank(F.substring("line", 1, MOST_CHARS) if truncate else F.col("line"))
    lines = lines.select("line_no", line.alias("line")).where(~F.col("line").rlike("^(%|#|//|$)"))
    lines = lines.withColumn("line", F.when(F.col("line").startswith("strict"), blank(F.substring("line", 7, 1 << 30))).otherwise(F.col("line")))
    header = F.when(F.col("line").startswith("digraph"), True).when(F.col("line").startswith("graph"), False)
    lines = lines.withColumn("header", header).where("header is not null or not line rlike '^[{}]'")
    chain = F.regexp_extract("line", r"^\d+(\s*(->|--)\s*\d+)*", 0)
    ids = F.transform(F.regexp_extract_all(chain, F.lit(r"(\d+)")), lambda x: F.try_to_number(x, F.lit("9" * 38)).cast("decimal(38,0)"))
    bad = F.array_position(F.transform(ids, lambda x: F.coalesce(x > MOST_ID, F.lit(True))), True)
    kept = F.when(bad > 0, F.slice(ids, 1, (bad - 1).cast("int"))).otherwise(ids)
    return lines.select(
        "line_no",
        "header",
        F.when(F.col("header").isNull(), F.transform(kept, lambda x: x.cast("long"))).otherwise(F.array().cast("array<long>")).alias("ids"),
        F.when(F.col("header").isNull(), F.regexp_extract("line", r"^\d+\s*(->|--)", 1)).alias("arrow"),
    ).where("header is not null or size(ids) > 0")


def summary(lines: DataFrame) -> DataFrame:
    """One row: n and directed. The last header decides, else the first arc operator, else directed."""
    arrow = F.when(F.col("arrow") != "", F.col("arrow") == "->")
    return lines.agg(
        (F.max(F.array_max("ids")) + 1).alias("n"),
        F.coalesce(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line_no"))), F.min_by(arrow, F.when(arrow.isNotNull(), F.col("line_no"))), F.lit(True)).alias("directed"),
    )


def chained(lines: DataFrame) -> DataFrame:
    """Edges of consecutive ids, weight 1.0. eid follows line and place: a line has fewer than 1024 of them."""
    pairs = F.when(F.size("ids") > 1, F.zip_with(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids")), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    found = lines.where("size(ids) > 1").select("line_no", F.posexplode(pairs).alias("pos", "e"))
    return found.select((F.col("line_no").cast("long") * (MOST_CHARS + 1) + F.col("pos")).alias("eid"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.lit(1.0).alias("w"))


def parse_dot(lines: DataFrame, policy: str = "star", truncate: bool = True) -> Graph:
    """A graph from lines(line_no, line). Raises if there is no vertex at all."""
    found = parsed(lines, truncate)
    head = summary(found).first()
    if head.n is None:
        raise InvalidArgument("no vertex")
    return Graph.from_edges(chained(found), head.n, head.directed, policy, check=False)


def read_dot(spark: SparkSession, path: str, policy: str = "star", truncate: bool = True) -> Graph:
    return parse_dot(read_lines(spark, path), policy, truncate)


def dot_lines(graph: Graph, traversal: DataFrame | None = None) -> DataFrame:
    """(section, k1, k2, line), the drawing's lines in the order of the first three."""
    arrow = "->" if graph.directed else "--"
    fixed = [(0, 0, "digraph G {" if graph.directed else "graph G {"), (0, 1, "  rankdir=LR;"), (0, 2, "  node [shape=circle, style=filled, fillcolor=white];"), (0, 3, ""), (2, 0, ""), (4, 0, "}")]
    frame = graph.spark.createDataFrame([(s, k, 0, t) for s, k, t in fixed], "section int, k1 long, k2 long, line string")
    nodes, arcs = graph.vertices.withColumnRenamed("id", "v"), graph.arcs()
    if not graph.directed:
        arcs = arcs.where("v >= u")
    dist: Column = F.lit(None).cast("int")
    tree: Column = F.lit(False)
    if traversal is not None:
        nodes = nodes.join(traversal.select("v", "dist"), "v", "left")
        parents = traversal.select("v", "parent")
        arcs = arcs.join(parents.withColumnRenamed("parent", "above"), "v", "left")
        dist, tree = F.col("dist"), F.col("above") == F.col("u")
        if not graph.directed:
            arcs = arcs.join(parents.select(F.col("v").alias("u"), F.col("parent").alias("beyond")), "u", "left")
            tree = tree | (F.col("beyond") == F.col("v"))
    label = F.concat(F.lit("  "), F.col("v"), F.lit(' [label="'), F.col("v"), F.lit("\\nd="), dist, F.lit('", fillcolor='), F.when(dist == 0, "orange").otherwise("lightblue"), F.lit("];"))
    node_lines = nodes.select(F.lit(1).alias("section"), F.col("v").alias("k1"), F.lit(0).cast("long").alias("k2"), F.when(dist >= 0, label).otherwise(F.concat(F.lit("  "), F.col("v"), F.lit(";"))).alias("line"))
    style = F.when(F.coalesce(tree, F.lit(False)), '", color=red, penwidth=2.0];').otherwise('", color=gray50];')
    edge_lines = arcs.select(F.lit(3).alias("section"), F.col("u").alias("k1"), F.col("pos").alias("k2"), F.concat(F.lit("  "), F.col("u"), F.lit(f" {arrow} "), F.col("v"), F.lit(' [label="'), general_format(F.col("w")), style).alias("line"))
    return frame.unionByName(node_lines).unionByName(edge_lines)


def write_dot(graph: Graph, path: str, traversal: DataFrame | None = None) -> None:
    """One file at path, on the driver, line by line from a distributed sort."""
    if not path:
        raise InvalidArgument("no path")
    if traversal is not None and traversal.count() != graph.n:
        raise InvalidArgument("the traversal is another graph's")
    ordered = dot_lines(graph, traversal).orderBy("section", "k1", "k2").select("line")
    try:
        with open(f"{path}.part", "w", encoding="utf-8", newline="\n") as f:
            f.writelines(f"{r.line}\n" for r in ordered.toLocalIterator())
        os.replace(f"{path}.part", path)
    except OSError as e:
        raise InvalidArgument(f"{path} can't be written") from e
