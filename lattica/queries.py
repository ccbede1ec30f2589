"""Named queries over the tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import adjacency as adj
from .operators import analytics, order, traverse
from .operators.containers import MinHeap, Queue, Stack
from .plans.loops import ensure_checkpoint_dir, tasks_for
from .plans.model import OPERATIONS, Graph, check_edges
from .sources import dot, tables
from .streaming.oplog import EdgeTable, stream_operations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL for the derived graphs ----------------------------------------------------------------------------------
C = "(SELECT count(*) FROM customer)"
S = "(SELECT count(*) FROM supplier)"
P = "(SELECT count(*) FROM part)"
GEO = f"""geo AS (
  SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey + 5 AS BIGINT) AS dst FROM nation
  UNION ALL SELECT CAST(c_nationkey + 5 AS BIGINT), CAST(c_custkey + 30 AS BIGINT) FROM customer
  UNION ALL SELECT CAST(s_nationkey + 5 AS BIGINT), CAST(s_suppkey + 30 + {C} AS BIGINT) FROM supplier),
geo_v AS (SELECT CAST(r_regionkey AS BIGINT) AS v FROM region UNION ALL SELECT dst FROM geo)"""
GEO_BFS = f"""WITH RECURSIVE {GEO},
r(v, d, path) AS (SELECT CAST(0 AS BIGINT), 0, '0' UNION ALL SELECT dst, d + 1, path || ' -> ' || CAST(dst AS VARCHAR) FROM r JOIN geo ON r.v = geo.src WHERE d < 6)"""
TRADE = f"""trade AS (
  SELECT CAST(o_custkey * {S} + l_suppkey AS BIGINT) AS eid, CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey + {C} AS BIGINT) AS dst, round(sum(l_extendedprice), 2) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey),
trade_v AS (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer UNION ALL SELECT CAST(s_suppkey + {C} AS BIGINT) FROM supplier)"""
LOG = f"""log AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq,
    CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS kind, CAST(l_partkey AS BIGINT) AS u, CAST(l_suppkey + {P} AS BIGINT) AS v, l_quantity AS w FROM lineitem)"""
LIVE = f"""{LOG},
gone AS (SELECT u, v, max(seq) AS at FROM log WHERE kind = 'remove' GROUP BY u, v),
live AS (SELECT min(l.seq) AS eid, l.u AS src, l.v AS dst, arg_max(l.w, l.seq) AS w FROM log l LEFT JOIN gone g ON l.u = g.u AND l.v = g.v
  WHERE l.kind = 'add' AND l.seq > coalesce(g.at, -1) GROUP BY l.u, l.v)"""
KIND = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
EVENTS = f"""steps AS (SELECT {KIND} AS src, lead({KIND}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
ev AS (SELECT CAST(src * 5 + dst AS BIGINT) AS eid, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS w FROM steps WHERE dst IS NOT NULL GROUP BY src, dst),
five AS (SELECT CAST(unnest(range(5)) AS BIGINT) AS v)"""
EVENTS_BOTH = f"""{EVENTS},
eu AS (SELECT CAST(least(src, dst) * 5 + greatest(src, dst) AS BIGINT) AS eid, least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM ev WHERE src <> dst GROUP BY least(src, dst), greatest(src, dst))"""
#: Breadth-first search of the event graph from 0; every other type follows it at once or is never reached in this query.
EVENTS_BFS = """lvl AS (SELECT dst AS v, row_number() OVER (ORDER BY {order}) AS ord FROM ev WHERE src = 0 AND dst <> 0),
bfs AS (SELECT f.v, CAST(CASE WHEN f.v = 0 THEN 0 WHEN l.v IS NULL THEN -1 ELSE 1 END AS INTEGER) AS dist, CAST(CASE WHEN l.v IS NULL THEN -1 ELSE 0 END AS BIGINT) AS parent,
  CAST(CASE WHEN f.v = 0 THEN 0 ELSE coalesce(l.ord, -1) END AS BIGINT) AS ord FROM five f LEFT JOIN lvl l ON f.v = l.v)"""
CHAIN = """chain AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders)"""
CHAIN_V = "ids AS (SELECT CAST(unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS BIGINT) AS v)"


#: Both directions of the trade graph's edges; positions are edge numbers.
ARCS = "arcs AS MATERIALIZED (SELECT src AS u, dst AS v, eid AS pos, w FROM trade UNION ALL SELECT dst, src, eid, w FROM trade)"
#: Vertices seen, as a string of bits.
BITS = f"set_bit(CAST(repeat('0', CAST({C} + {S} AS INTEGER)) AS BIT), 0, 1)"


def _levels_sql(most: int) -> str:
    """Breadth-first search of the undirected trade graph from 0 with order and parents, a level at a time: the table `bfs`."""
    out = f"""WITH {TRADE}, {ARCS}, l0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS v, 0 AS dist, CAST(-1 AS BIGINT) AS parent, CAST(0 AS BIGINT) AS ord), s0 AS MATERIALIZED (SELECT * FROM l0)"""
    for k in range(most):
        out += f""", c{k} AS MATERIALIZED (SELECT a.v, a.u AS parent, l.ord AS f, a.pos, row_number() OVER (PARTITION BY a.v ORDER BY l.ord, a.pos) AS k FROM l{k} l JOIN arcs a ON a.u = l.v WHERE a.v NOT IN (SELECT v FROM s{k})),
l{k + 1} AS MATERIALIZED (SELECT v, {k + 1} AS dist, parent, (SELECT count(*) FROM s{k}) + row_number() OVER (ORDER BY f, pos) - 1 AS ord FROM c{k} WHERE k = 1),
s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT * FROM l{k + 1})"""
    return out + f", bfs AS (SELECT id AS v, CAST(coalesce(dist, -1) AS INTEGER) AS dist, CAST(coalesce(parent, -1) AS BIGINT) AS parent, CAST(coalesce(ord, -1) AS BIGINT) AS ord FROM trade_v LEFT JOIN s{most} s ON id = s.v)"


TRADE_BFS = _levels_sql(6)
TRADE_DFS = f"""WITH RECURSIVE {TRADE}, {ARCS},
adj AS MATERIALIZED (SELECT u, list(v ORDER BY pos) AS vs FROM arcs GROUP BY u),
walk(step, stack, seen, new, above) AS (
  SELECT 0, [CAST(0 AS BIGINT)], {BITS}, CAST(0 AS BIGINT), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT step + 1, CASE WHEN nxt IS NULL THEN stack[:-2] ELSE list_append(stack, nxt) END, CASE WHEN nxt IS NULL THEN seen ELSE set_bit(seen, CAST(nxt AS INTEGER), 1) END, nxt, stack[-1]
  FROM (SELECT k.*, list_filter(a.vs, lambda x: get_bit(k.seen, CAST(x AS INTEGER)) = 0)[1] AS nxt FROM walk k LEFT JOIN adj a ON a.u = k.stack[-1] WHERE len(k.stack) > 0) t),
found AS (SELECT new AS v, CAST(len(stack) - 1 AS INTEGER) AS dist, above AS parent, row_number() OVER (ORDER BY step) - 1 AS ord FROM walk WHERE new IS NOT NULL)
SELECT id AS v, CAST(coalesce(dist, -1) AS INTEGER) AS dist, CAST(coalesce(parent, -1) AS BIGINT) AS parent, CAST(coalesce(ord, -1) AS BIGINT) AS ord FROM trade_v LEFT JOIN found ON id = v"""
#: The tree of vertex 0, grown by the least edge that leaves it. All vertices with edges are in it at every scale of the tables.
TRADE_TREE = f"""WITH RECURSIVE {TRADE}, {ARCS},
grow(seen, e) AS (
  SELECT {BITS}, CAST(-1 AS BIGINT)
  UNION ALL
  SELECT set_bit(any_value(g.seen), CAST(arg_min(a.v, (a.w, a.pos)) AS INTEGER), 1), arg_min(a.pos, (a.w, a.pos))
  FROM grow g JOIN arcs a ON get_bit(g.seen, CAST(a.u AS INTEGER)) = 1 AND get_bit(g.seen, CAST(a.v AS INTEGER)) = 0 HAVING count(*) > 0)
SELECT eid, src, dst, w FROM trade JOIN grow ON eid = e"""


def _relaxed_sql(rounds: int) -> str:
    """Least sums of weights from 0 over the undirected trade graph, after so many rounds over all arcs."""
    out = f"WITH {TRADE}, {ARCS}, d0 AS MATERIALIZED (SELECT id AS v, CASE WHEN id = 0 THEN CAST(0 AS DOUBLE) END AS d FROM trade_v)"
    for k in range(rounds):
        out += f", d{k + 1} AS MATERIALIZED (SELECT o.v, least(o.d, n.d) AS d FROM d{k} o LEFT JOIN (SELECT a.v, min(d + w) AS d FROM d{k} x JOIN arcs a ON a.u = x.v GROUP BY a.v) n ON o.v = n.v)"
    return out + f" SELECT v, round(d, 2) AS distance FROM d{rounds}"


# --- counts, lookups, neighbours -----------------------------------------------------------------------------
@query(f"WITH {TRADE} SELECT id, CAST(count(src) AS BIGINT) AS degree FROM trade_v LEFT JOIN trade ON id = src GROUP BY id")
def out_degree(spark, sf_dir):
    return adj.out_degrees(tables.trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT id, CAST(count(dst) AS BIGINT) AS degree FROM trade_v LEFT JOIN trade ON id = dst GROUP BY id")
def in_degree(spark, sf_dir):
    return adj.in_degrees(tables.trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT id, CAST(count(x) AS BIGINT) AS degree FROM trade_v LEFT JOIN (SELECT src AS x FROM trade UNION ALL SELECT dst FROM trade) a ON id = x GROUP BY id")
def degree_undirected(spark, sf_dir):
    return adj.in_degrees(tables.trade(spark, sf_dir, directed=False))


@query(f"WITH {TRADE} SELECT CAST({C} + {S} AS BIGINT) AS n, count(*) AS m, CAST(sum(CASE WHEN src = dst THEN 1 ELSE 2 END) AS BIGINT) AS arcs, count(*) FILTER (WHERE src = dst) AS loops FROM trade")
def arc_count(spark, sf_dir):
    return adj.counts(tables.trade(spark, sf_dir, directed=False))


@query(f"WITH {EVENTS} SELECT CAST(5 AS BIGINT) AS n, count(*) AS m, count(*) AS arcs, count(*) FILTER (WHERE src = dst) AS loops FROM ev")
def arc_count_loops(spark, sf_dir):
    return adj.counts(tables.event_transitions(spark, sf_dir))


@query(f"WITH {TRADE} SELECT src AS u, row_number() OVER (PARTITION BY src ORDER BY eid) - 1 AS rank, dst AS v, w FROM trade")
def neighbors_out(spark, sf_dir):
    graph = tables.trade(spark, sf_dir)
    return adj.neighbors_out(graph, graph.vertices.withColumnRenamed("id", "u"))


@query(f"WITH {TRADE} SELECT dst AS v, row_number() OVER (PARTITION BY dst ORDER BY eid) - 1 AS rank, src AS u, w FROM trade")
def neighbors_in(spark, sf_dir):
    graph = tables.trade(spark, sf_dir)
    return adj.neighbors_in(graph, graph.vertices.withColumnRenamed("id", "v"))


@query(f"WITH {LIVE} SELECT src AS u, row_number() OVER (PARTITION BY src ORDER BY eid DESC) - 1 AS rank, dst AS v, w FROM live")
def neighbors_list_policy(spark, sf_dir):
    log, n = tables.part_operations(spark, sf_dir)
    graph = Graph.from_operations(log, n, True, check=False)
    return adj.neighbors_out(graph, graph.vertices.withColumnRenamed("id", "u"))


@query(f"WITH {LIVE} SELECT dst AS v, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS rank, src AS u, w FROM live")
def neighbors_in_list_policy(spark, sf_dir):
    log, n = tables.part_operations(spark, sf_dir)
    graph = Graph.from_operations(log, n, True, check=False)
    return adj.neighbors_in(graph, graph.vertices.withColumnRenamed("id", "v"))


def _pairs(spark, sf_dir):
    c, s = tables.read(spark, sf_dir, "customer").count(), tables.read(spark, sf_dir, "supplier").count()
    return tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % s + c).alias("v"))


PAIRS = f"pairs AS (SELECT CAST(o_custkey AS BIGINT) AS u, CAST(o_orderkey % {S} + {C} AS BIGINT) AS v FROM orders)"


@query(f"WITH {TRADE}, {PAIRS} SELECT u, v, coalesce(w, 0.0) <> 0.0 AS found FROM pairs LEFT JOIN trade ON u = src AND v = dst")
def has_edge(spark, sf_dir):
    return adj.edges_exist(tables.trade(spark, sf_dir), _pairs(spark, sf_dir))


@query(f"WITH {TRADE}, {PAIRS} SELECT u, v, coalesce(w, 0.0) <> 0.0 AS found FROM pairs LEFT JOIN trade ON u = src AND v = dst")
def has_edge_stored(spark, sf_dir):
    """Lookups in a graph that is stored by source."""
    return adj.edges_exist(tables.trade(spark, sf_dir).stored(), _pairs(spark, sf_dir))


@query(f"WITH {TRADE} SELECT row_number() OVER (ORDER BY eid) - 1 AS rank, dst AS v, w FROM trade WHERE src = 1")
def iter_next_all(spark, sf_dir):
    """Successors of one vertex, pulled one by one."""
    pulled = adj.iter_out(tables.trade(spark, sf_dir).stored(), 1)
    return spark.createDataFrame([(k, v, w) for k, (v, w) in enumerate(pulled)], "rank long, v long, w double")


@query(f"WITH {TRADE}, {PAIRS} SELECT u, v, CAST(coalesce(w, 0.0) AS DOUBLE) AS w FROM pairs LEFT JOIN trade ON u = src AND v = dst")
def edge_weight_batch(spark, sf_dir):
    return adj.weights_of(tables.trade(spark, sf_dir), _pairs(spark, sf_dir))


@query(f"WITH {TRADE}, h AS (SELECT id, count(src) AS k FROM trade_v LEFT JOIN trade ON id = src GROUP BY id) SELECT id, CAST(sum(k) OVER (ORDER BY id) - k AS BIGINT) AS head FROM h UNION ALL SELECT CAST({C} + {S} AS BIGINT), (SELECT count(*) FROM trade)")
def csr_offsets(spark, sf_dir):
    return adj.csr_offsets(tables.trade(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT a.v AS u, b.v, CAST(coalesce(w, 0.0) AS DOUBLE) AS w FROM five a CROSS JOIN five b LEFT JOIN ev ON a.v = src AND b.v = dst")
def matrix_dense(spark, sf_dir):
    return adj.dense(tables.event_transitions(spark, sf_dir).with_policy("matrix"))


# --- construction and mutation ---------------------------------------------------------------------------------
def _additions(spark, sf_dir):
    log, n = tables.part_operations(spark, sf_dir)
    return log.where("kind = 'add'").select(F.col("seq").alias("eid"), F.col("u").alias("src"), F.col("v").alias("dst"), "w"), n


@query(f"WITH {LOG} SELECT u, v, count(*) AS parallel, arg_min(w, seq) AS w FROM log WHERE kind = 'add' GROUP BY u, v")
def from_edges_star_multi(spark, sf_dir):
    graph = Graph.from_edges(*_additions(spark, sf_dir), True, "star")
    arcs = graph.arcs()
    parallel = arcs.repartition(tasks_for(arcs), "u", "v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("parallel"))
    return parallel.join(adj.weights_of(graph, parallel.select("u", "v")), ["u", "v"]).select("u", "v", "parallel", "w")


@query(f"WITH {LOG} SELECT min(seq) AS eid, u AS src, v AS dst, arg_max(w, seq) AS w FROM log WHERE kind = 'add' GROUP BY u, v")
def upsert_list(spark, sf_dir):
    log, n = tables.part_operations(spark, sf_dir)
    return Graph.from_operations(log.where("kind = 'add'"), n, True).edges


@query(f"WITH {LOG} SELECT min(seq) AS eid, u AS src, v AS dst, arg_max(w, seq) AS w FROM log WHERE kind = 'add' GROUP BY u, v")
def convert_policy(spark, sf_dir):
    return Graph.from_edges(*_additions(spark, sf_dir), False, "star", check=False).with_policy("list").edges


@query(f"WITH {LIVE} SELECT eid, src, dst, w FROM live")
def remove_edge(spark, sf_dir):
    log, n = tables.part_operations(spark, sf_dir)
    return Graph.from_operations(log, n, True).edges


@query("SELECT CAST(e AS BIGINT) AS eid, CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, w FROM (VALUES (1, 0, 2, 3.0::DOUBLE), (5, 0, 1, 7.0::DOUBLE), (3, 2, 2, 1.5::DOUBLE)) t(e, a, b, w)")
def create_and_mutate(spark, sf_dir):
    """An empty mutable graph, edges added, set again, removed, and added again."""
    graph = Graph.create(spark, 3, True).add_edge(0, 1, 2.0).add_edge(0, 2, 3.0).add_edge(0, 1, 5.0)
    log = [(3, "add", 2, 2, 1.5), (4, "remove", 0, 1, None), (5, "add", 0, 1, 7.0), (6, "remove", 1, 2, None)]
    return graph.apply(spark.createDataFrame(log, OPERATIONS)).edges


@query(f"WITH {LIVE} SELECT eid, src, dst, live.w FROM live JOIN gone ON src = u AND dst = v")
def readd_edge(spark, sf_dir):
    log, n = tables.part_operations(spark, sf_dir)
    removed = log.where("kind = 'remove'").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return Graph.from_operations(log, n, True, check=False).edges.join(removed, ["src", "dst"], "left_semi").select("eid", "src", "dst", "w")


@query(f"WITH {TRADE} SELECT count(*) AS edges, count(*) FILTER (WHERE dst >= {C} + {S} // 2 OR w = 0) AS invalid FROM trade")
def validate_edges(spark, sf_dir):
    graph, s = tables.trade(spark, sf_dir), tables.read(spark, sf_dir, "supplier").count()
    return check_edges(graph.edges, graph.n - s + s // 2)


@query(f"WITH {LIVE} SELECT eid, src, dst, w FROM live")
def stream_upsert(spark, sf_dir):
    """The log in three parts, streamed one by one into an edge table."""
    log, n = tables.part_operations(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    third = log.count() // 3 + 1
    table = EdgeTable(spark, f"{folder}/edges", n, True)
    for k in range(3):
        log.where(F.floor(F.col("seq") / third) == k).write.mode("append").parquet(f"{folder}/log")
        # files of a part come in any order: a batch takes all that are there
        stream_operations(spark, f"{folder}/log", table, f"{folder}/progress", max_files=2**31 - 1).awaitTermination()
    return table.graph().edges


# --- traversals ----------------------------------------------------------------------------------------------------
@query(f"{GEO_BFS} SELECT g.v, CAST(coalesce(d, -1) AS INTEGER) AS dist FROM geo_v g LEFT JOIN r ON g.v = r.v")
def bfs_geo(spark, sf_dir):
    return traverse.bfs(tables.geo(spark, sf_dir), 0).select("v", "dist")


@query(f"{GEO_BFS} SELECT g.v, CAST(coalesce(d, -1) AS INTEGER) AS dist FROM geo_v g LEFT JOIN r ON g.v = r.v")
def bfs_geo_levels(spark, sf_dir):
    return traverse.distances(tables.geo(spark, sf_dir), 0)


@query(f"""WITH RECURSIVE {TRADE}, arcs AS (SELECT src AS u, dst AS v FROM trade UNION ALL SELECT dst, src FROM trade),
r(v, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT a.v, d + 1 FROM r JOIN arcs a ON r.v = a.u WHERE d < 5)
SELECT id AS v, CAST(coalesce(min(d), -1) AS INTEGER) AS dist FROM trade_v LEFT JOIN r ON id = r.v GROUP BY id""")
def bfs_trade(spark, sf_dir):
    return traverse.bfs(tables.trade(spark, sf_dir, directed=False), 0).select("v", "dist")


@query(f"{TRADE_BFS} SELECT * FROM bfs")
def bfs_trade_full(spark, sf_dir):
    return traverse.bfs(tables.trade(spark, sf_dir, directed=False), 0)


@query(f"{TRADE_BFS} SELECT * FROM bfs")
def bfs_trade_levels(spark, sf_dir):
    """As it runs beyond one task: a join for each level."""
    return traverse.bfs(tables.trade(spark, sf_dir, directed=False), 0, small=0)


@query(f"WITH {EVENTS}, {EVENTS_BFS.format(order='eid DESC')} SELECT v, dist, parent, ord FROM bfs")
def bfs_list_levels(spark, sf_dir):
    return traverse.bfs(tables.event_transitions(spark, sf_dir).with_policy("list"), 0, small=0)


@query(f"""WITH RECURSIVE {CHAIN}, {CHAIN_V},
r(v, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT dst, d + 1 FROM r JOIN chain ON r.v = src WHERE dst IS NOT NULL)
SELECT ids.v, CAST(coalesce(d, -1) AS INTEGER) AS dist FROM ids LEFT JOIN r ON ids.v = r.v""")
def bfs_chain_levels(spark, sf_dir):
    return traverse.distances(tables.order_chain(spark, sf_dir), 0)


@query(f"""WITH RECURSIVE {CHAIN}, {CHAIN_V},
r(v, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT dst, d + 1 FROM r JOIN chain ON r.v = src WHERE dst IS NOT NULL)
SELECT ids.v, CAST(coalesce(d, -1) AS INTEGER) AS dist FROM ids LEFT JOIN r ON ids.v = r.v""")
def bfs_order_chain(spark, sf_dir):
    return traverse.bfs(tables.order_chain(spark, sf_dir), 0).select("v", "dist")


@query(f"WITH {EVENTS}, {EVENTS_BFS.format(order='eid')} SELECT v, dist, parent, ord FROM bfs")
def bfs_full_star(spark, sf_dir):
    return traverse.bfs(tables.event_transitions(spark, sf_dir), 0)


@query(f"WITH {EVENTS}, {EVENTS_BFS.format(order='eid DESC')} SELECT v, dist, parent, ord FROM bfs")
def bfs_full_list(spark, sf_dir):
    return traverse.bfs(tables.event_transitions(spark, sf_dir).with_policy("list"), 0)


@query(f"{GEO_BFS} SELECT v, path FROM r")
def bfs_paths(spark, sf_dir):
    return traverse.paths(traverse.bfs(tables.geo(spark, sf_dir), 0))


@query(f"{GEO_BFS} SELECT count(*) AS reached FROM r")
def reached_count(spark, sf_dir):
    return traverse.reached_count(traverse.bfs(tables.geo(spark, sf_dir), 0))


@query(f"{GEO_BFS} SELECT g.v, CAST(coalesce(d, -1) AS INTEGER) AS dist FROM geo_v g LEFT JOIN r ON g.v = r.v")
def dfs_geo(spark, sf_dir):
    return traverse.dfs(tables.geo(spark, sf_dir), 0).select("v", "dist")


@query(TRADE_DFS)
def dfs_trade_full(spark, sf_dir):
    return traverse.dfs(tables.trade(spark, sf_dir, directed=False), 0)


# --- orders, heaps, forests --------------------------------------------------------------------------------------------
@query(f"WITH {TRADE} SELECT eid, src, dst, w, row_number() OVER (ORDER BY w, eid) - 1 AS rank FROM trade")
def sort_edges(spark, sf_dir):
    return order.sort_edges(tables.trade(spark, sf_dir).edges)


@query(f"""WITH {TRADE}, p AS (SELECT *, row_number() OVER (ORDER BY eid) - 1 AS k FROM trade)
SELECT eid, src, dst, w, k AS rank FROM p WHERE k < 100 OR k > 1000
UNION ALL SELECT eid, src, dst, w, row_number() OVER (ORDER BY w, eid) + 99 FROM p WHERE k BETWEEN 100 AND 1000""")
def sort_range(spark, sf_dir):
    return order.sort_range(tables.trade(spark, sf_dir).edges, 100, 1000)


@query(f"WITH {TRADE} SELECT eid, src, dst, w, row_number() OVER (ORDER BY w, eid) - 1 AS rank FROM trade ORDER BY w, eid LIMIT 100")
def topk_edges(spark, sf_dir):
    return order.least_edges(tables.trade(spark, sf_dir).edges, 100)


def _keys(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7).alias("k"))


@query("SELECT CAST(o_orderkey * 7 AS BIGINT) AS k FROM orders ORDER BY k LIMIT 10")
def extract_min_k(spark, sf_dir):
    return order.extract_min(_keys(spark, sf_dir), 10)[0]


@query("SELECT k FROM (SELECT CAST(o_orderkey * 7 AS BIGINT) AS k, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) t WHERE i > 10")
def extract_min_rest(spark, sf_dir):
    return order.extract_min(_keys(spark, sf_dir), 10)[1]


@query("SELECT CAST(CASE WHEN o_orderkey * 7 = 70 THEN 65 ELSE o_orderkey * 7 END AS BIGINT) AS k FROM orders")
def decrease_key(spark, sf_dir):
    return order.decrease_key(_keys(spark, sf_dir), 70, 5)


@query("SELECT CAST(o_orderkey * 7 AS BIGINT) AS k FROM orders UNION ALL SELECT CAST(o_orderkey * 7 + 1 AS BIGINT) FROM orders")
def heap_insert(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    return order.insert_keys(keys, keys.select((F.col("k") + 1).alias("k")))


MST = f"""WITH RECURSIVE {EVENTS_BOTH},
r(e, v) AS (SELECT eid, src FROM eu UNION SELECT r.e, CASE WHEN x.src = r.v THEN x.dst ELSE x.src END FROM r JOIN eu o ON o.eid = r.e JOIN eu x ON (x.src = r.v OR x.dst = r.v) AND (x.w < o.w OR (x.w = o.w AND x.eid < o.eid)))
SELECT eid, src, dst, w FROM eu WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.e = eu.eid AND r.v = eu.dst)"""


@query(MST)
def mst_events(spark, sf_dir):
    return order.minimum_spanning_forest(tables.event_transitions(spark, sf_dir, directed=False))


@query(MST)
def mst_events_rounds(spark, sf_dir):
    return order.minimum_spanning_forest(tables.event_transitions(spark, sf_dir, directed=False), small=0)


@query(MST)
def prim_events(spark, sf_dir):
    return order.prim(tables.event_transitions(spark, sf_dir, directed=False), 0)


@query(TRADE_TREE)
def mst_trade(spark, sf_dir):
    return order.minimum_spanning_forest(tables.trade(spark, sf_dir, directed=False))


@query(TRADE_TREE)
def mst_trade_rounds(spark, sf_dir):
    """As it runs beyond one task: every component takes its least edge, round by round."""
    return order.minimum_spanning_forest(tables.trade(spark, sf_dir, directed=False), small=0)


@query(TRADE_TREE)
def prim_trade(spark, sf_dir):
    return order.prim(tables.trade(spark, sf_dir, directed=False), 0)


# --- DOT -----------------------------------------------------------------------------------------------------------------
DOT_LINES = f"""WITH {EVENTS}, {EVENTS_BFS.format(order='eid')}
SELECT 0 AS section, CAST(k AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, line FROM (VALUES (0, 'digraph G {{'), (1, '  rankdir=LR;'), (2, '  node [shape=circle, style=filled, fillcolor=white];'), (3, '')) t(k, line)
UNION ALL SELECT 1, v, 0, CASE WHEN dist >= 0 THEN '  ' || v || ' [label="' || v || '\\nd=' || dist || '", fillcolor=' || CASE WHEN dist = 0 THEN 'orange' ELSE 'lightblue' END || '];' ELSE '  ' || v || ';' END FROM bfs
UNION ALL SELECT 2, 0, 0, ''
UNION ALL SELECT 3, src, eid, '  ' || src || ' -> ' || dst || ' [label="' || CAST(w AS BIGINT) || CASE WHEN parent = src AND dist > 0 THEN '", color=red, penwidth=2.0];' ELSE '", color=gray50];' END FROM ev JOIN bfs ON dst = v
UNION ALL SELECT 4, 0, 0, '}}'"""


@query(DOT_LINES)
def dot_export_lines(spark, sf_dir):
    graph = tables.event_transitions(spark, sf_dir)
    return dot.dot_lines(graph, traverse.bfs(graph, 0))


@query(f"""{TRADE_BFS},
lines AS (SELECT 0 AS section, CAST(k AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, line FROM (VALUES (0, 'graph G {{'), (1, '  rankdir=LR;'), (2, '  node [shape=circle, style=filled, fillcolor=white];'), (3, '')) t(k, line)
UNION ALL SELECT 1, v, 0, CASE WHEN dist >= 0 THEN '  ' || v || ' [label="' || v || '\\nd=' || dist || '", fillcolor=' || CASE WHEN dist = 0 THEN 'orange' ELSE 'lightblue' END || '];' ELSE '  ' || v || ';' END FROM bfs
UNION ALL SELECT 2, 0, 0, ''
UNION ALL SELECT 3, src, eid, '  ' || src || ' -- ' || dst || ' [label="' || format('{{:g}}', w) || CASE WHEN a.parent = dst OR b.parent = src THEN '", color=red, penwidth=2.0];' ELSE '", color=gray50];' END FROM trade JOIN bfs a ON src = a.v JOIN bfs b ON dst = b.v
UNION ALL SELECT 4, 0, 0, '}}')
SELECT * FROM lines""")
def dot_export_undirected(spark, sf_dir):
    """Weights with fractions, and tree edges in both directions."""
    graph = tables.trade(spark, sf_dir, directed=False).kept()
    return dot.dot_lines(graph, traverse.bfs(graph, 0))


@query(f"WITH lines AS ({DOT_LINES}) SELECT CAST(row_number() OVER (ORDER BY section, k1, k2) - 1 AS BIGINT) AS line_no, line FROM lines")
def dot_export_file(spark, sf_dir):
    """The drawing as a file on the driver, read again."""
    graph = tables.event_transitions(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        dot.write_dot(graph, f"{folder}/events.dot", traverse.bfs(graph, 0))
        with open(f"{folder}/events.dot", encoding="utf-8") as f:
            lines = f.read().splitlines()
    return spark.createDataFrame([*enumerate(lines)], "line_no long, line string")


def _chain_text(spark, sf_dir):
    edges = tables.order_chain(spark, sf_dir).edges
    head = spark.createDataFrame([(0, "digraph G {"), (1, "% orders")], "line_no long, line string")
    return head.unionByName(edges.select((F.col("src") + 2).alias("line_no"), F.concat(F.lit("\t"), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(" [color=red];")).alias("line")))


@query(f"WITH {CHAIN} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM chain WHERE dst IS NOT NULL")
def dot_import_edges(spark, sf_dir):
    return dot.parse_dot(_chain_text(spark, sf_dir)).edges.select("src", "dst", "w")


@query(f"WITH {CHAIN} SELECT CAST(max(greatest(src, dst)) + 1 AS BIGINT) AS n, true AS directed FROM chain WHERE dst IS NOT NULL")
def dot_import_summary(spark, sf_dir):
    return dot.summary(dot.parsed(_chain_text(spark, sf_dir)))


@query(f"WITH {CHAIN} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM chain WHERE dst IS NOT NULL")
def dot_read_file(spark, sf_dir):
    """From a path, as graphs come in."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/dot-{uuid.uuid4().hex}"
    dot.write_lines(_chain_text(spark, sf_dir), f"{folder}/orders.dot")
    return dot.read_dot(spark, f"{folder}/orders.dot").edges.select("src", "dst", "w")


def _walks(spark, sf_dir):
    """Text without a header: each customer's orders as one chain, and lines of every kind that gives no edge."""
    walks = tables.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    chain = F.concat(F.lit("\t"), F.array_join(F.transform("o", lambda x: x["o_orderkey"].cast("string")), " -- "), F.lit(" [color=red]; 1 -- 2;\r"))
    others = ["# 1 -- 2", "  // 1 -- 2", "% 1 -- 2", "", "{ 1 -- 2", "} 1 -- 2", '"1" -- "2"', "a -- b", "-5 -- 1", "1 -- 4294967296", "4294967296 -- 1", "2 --", "/* x */ 1 -- 2"]
    lines = F.inline(F.array(F.struct((F.col("o_custkey") * 16).alias("line_no"), chain.alias("line")), *(F.struct((F.col("o_custkey") * 16 + k + 1).alias("line_no"), F.lit(x).alias("line")) for k, x in enumerate(others))))
    return walks.select("o_custkey", "o").select(lines)


@query(f"WITH {CHAIN} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w, false AS directed FROM chain WHERE dst IS NOT NULL")
def dot_import_chains(spark, sf_dir):
    graph = dot.parse_dot(_walks(spark, sf_dir))
    return graph.edges.select("src", "dst", "w", F.lit(graph.directed).alias("directed"))


@query("""WITH lines AS (SELECT o_custkey % 7 AS k, substr(string_agg(CAST(o_orderkey AS VARCHAR), '->' ORDER BY o_orderkey), 1, 1023) AS line FROM orders GROUP BY o_custkey % 7),
ids AS (SELECT k, generate_subscripts(x, 1) AS i, CAST(unnest(x) AS BIGINT) AS id FROM (SELECT k, regexp_extract_all(line, '[0-9]+') AS x FROM lines) t),
pairs AS (SELECT k, i, id AS src, lead(id) OVER (PARTITION BY k ORDER BY i) AS dst FROM ids)
SELECT CAST(k * 1024 + i - 1 AS BIGINT) AS eid, src, dst FROM pairs WHERE dst IS NOT NULL""")
def dot_import_truncated(spark, sf_dir):
    """Lines beyond 1023 characters are cut there, in the middle of an id if need be."""
    orders = tables.read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("line_no")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    return dot.parse_dot(orders.select("line_no", F.array_join(F.transform("o", lambda x: x.cast("string")), "->").alias("line"))).edges.select("eid", "src", "dst")


# --- containers on the driver ------------------------------------------------------------------------------------------
def _nation_keys(spark, sf_dir):
    return [r[0] for r in tables.read(spark, sf_dir, "nation").orderBy("n_nationkey").select((F.col("n_nationkey") * 37 % 101).cast("int")).collect()]


@query("SELECT row_number() OVER (ORDER BY k) - 1 AS place, CAST(k AS BIGINT) AS k FROM (SELECT CASE WHEN n_nationkey = 9 THEN n_nationkey * 37 % 101 - 1 ELSE n_nationkey * 37 % 101 END AS k FROM nation) t")
def heap_container(spark, sf_dir):
    heap = MinHeap()
    for k in _nation_keys(spark, sf_dir):
        heap.insert(k)
    heap.decrease_key(9 * 37 % 101, 1)
    return spark.createDataFrame([(i, heap.extract_min()) for i in range(len(heap))], "place long, k long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS place, CAST(n_nationkey * 37 % 101 AS BIGINT) AS first_in, CAST((24 - n_nationkey) * 37 % 101 AS BIGINT) AS last_in FROM nation")
def queue_and_stack(spark, sf_dir):
    keys = _nation_keys(spark, sf_dir)
    queue, stack = Queue(len(keys)), Stack(len(keys))
    for k in keys:
        queue.enqueue(k)
        stack.push(k)
    return spark.createDataFrame([(i, queue.dequeue()[1], stack.pop()[1]) for i in range(len(keys))], "place long, first_in long, last_in long")


# --- extensions ------------------------------------------------------------------------------------------------------
@query(f"WITH {CHAIN_V} SELECT v, CAST(coalesce(min(o_orderkey) OVER (PARTITION BY coalesce(o_custkey, -1 - v)), v) AS BIGINT) AS component FROM ids LEFT JOIN orders ON v = o_orderkey")
def components_chain(spark, sf_dir):
    return analytics.components(tables.order_chain(spark, sf_dir))


@query(f"{GEO_BFS} SELECT g.v, CAST(d AS DOUBLE) AS distance FROM geo_v g LEFT JOIN r ON g.v = r.v")
def sssp_geo(spark, sf_dir):
    return analytics.shortest_paths(tables.geo(spark, sf_dir), 0)


@query(_relaxed_sql(20))
def sssp_trade(spark, sf_dir):
    return analytics.shortest_paths(tables.trade(spark, sf_dir, directed=False), 0).select("v", F.round("distance", 2).alias("distance"))


def _trade_rank_sql(rounds: int) -> str:
    n = f"({C} + {S})"
    out = f"WITH {TRADE}, {ARCS}, o AS MATERIALIZED (SELECT u, count(*) AS k FROM arcs GROUP BY u), r0 AS MATERIALIZED (SELECT id AS v, 1.0::DOUBLE / {n} AS rank FROM trade_v)"
    for i in range(rounds):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT f.id AS v, (1 - 0.85) / {n} + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE v NOT IN (SELECT u FROM o)) / {n} + 0.85 * coalesce(g.got, 0) AS rank
FROM trade_v f LEFT JOIN (SELECT a.v, sum(r.rank / o.k) AS got FROM arcs a JOIN o ON a.u = o.u JOIN r{i} r ON a.u = r.v GROUP BY a.v) g ON f.id = g.v)"""
    return out + f" SELECT v, round(rank, 8) AS rank FROM r{rounds}"


@query(_trade_rank_sql(5))
def pagerank_trade(spark, sf_dir):
    return analytics.pagerank(tables.trade(spark, sf_dir, directed=False), 5).select("v", F.round("rank", 8).alias("rank"))


def _rank_sql(rounds: int) -> str:
    out = f"WITH {EVENTS}, o AS (SELECT src, count(*) AS k FROM ev GROUP BY src), r0 AS (SELECT v, 0.2::DOUBLE AS rank FROM five)"
    for i in range(rounds):
        out += f""", r{i + 1} AS (SELECT f.v, (1 - 0.85) / 5 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE v NOT IN (SELECT src FROM o)) / 5 + 0.85 * coalesce(sum(r.rank / o.k), 0) AS rank
FROM five f LEFT JOIN ev ON f.v = ev.dst LEFT JOIN o ON ev.src = o.src LEFT JOIN r{i} r ON ev.src = r.v GROUP BY f.v)"""
    return out + f" SELECT v, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(5))
def pagerank_events(spark, sf_dir):
    return analytics.pagerank(tables.event_transitions(spark, sf_dir), 5).select("v", F.round("rank", 6).alias("rank"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS id FROM conversations), c AS (SELECT id AS src, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM t)
SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM c WHERE dst IS NOT NULL""")
def conversation_edges(spark, sf_dir):
    return tables.conversation_chain(spark, sf_dir).edges.select("src", "dst", "w")
