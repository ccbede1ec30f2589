"""Contracts of the graph model, traversals, orders and forests; traversals against sequential ones on random graphs."""

import random
import re
from collections import deque

import pyarrow as pa
import pytest

from lattica.errors import ImmutableGraph, InvalidArgument
from lattica.operators import adjacency as adj
from lattica.operators import analytics, order, traverse
from lattica.plans import loops
from lattica.plans.loops import Dealt, with_rank
from lattica.plans.model import EDGES, OPERATIONS, Graph
from lattica.plans.stars import stars

DEMO = [(0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.5), (2, 3, 1.0), (2, 4, 3.0), (7, 8, 5.0), (3, 5, 2.0), (4, 5, 1.0), (5, 6, 1.0), (6, 7, 4.0)]


def graph(spark, edges, n, directed, policy="star"):
    rows = [(i, u, v, float(w)) for i, (u, v, w) in enumerate(edges)]
    return Graph.from_edges(spark.createDataFrame(rows, EDGES), n, directed, policy)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def ordered(edges, n, directed, policy):
    """Neighbours in order, by plain Python."""
    if policy != "star":
        kept = {}
        for u, v, w in edges:
            key = (u, v) if directed else (min(u, v), max(u, v))
            kept.setdefault(key, None)
        edges = [(u, v, 1.0) for u, v in kept]
    out = [[] for _ in range(n)]
    for u, v, _ in edges:
        out[u].append(v)
        if not directed and u != v:
            out[v].append(u)
    if policy == "list":
        out = [x[::-1] for x in out]
    if policy == "matrix":
        out = [sorted(x) for x in out]
    return out


def plain_bfs(out, source):
    dist, parent, ord_ = {source: 0}, {source: -1}, {source: 0}
    queue = deque([source])
    while queue:
        u = queue.popleft()
        for v in out[u]:
            if v not in dist:
                dist[v], parent[v], ord_[v] = dist[u] + 1, u, len(ord_)
                queue.append(v)
    return sorted((v, dist.get(v, -1), parent.get(v, -1), ord_.get(v, -1)) for v in range(len(out)))


def plain_dfs(out, source):
    found = {}

    def visit(u, depth, parent):
        found[u] = (depth, parent, len(found))
        for v in out[u]:
            if v not in found:
                visit(v, depth + 1, u)

    visit(source, 0, -1)
    return sorted((v, *found.get(v, (-1, -1, -1))) for v in range(len(out)))


def random_edges(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), float(r.randint(1, 9))) for _ in range(m)]


@pytest.mark.parametrize("policy", ["star", "list", "matrix"])
@pytest.mark.parametrize("directed", [True, False])
def test_traversals_match_sequential_ones(spark, policy, directed):
    for seed in range(3):
        edges = random_edges(seed, 14, 24)
        g = graph(spark, edges, 14, directed, policy)
        out = ordered(edges, 14, directed, policy)
        assert rows(traverse.bfs(g, 0), "v", "dist", "parent", "ord") == plain_bfs(out, 0)
        assert rows(traverse.dfs(g, 0), "v", "dist", "parent", "ord") == plain_dfs(out, 0)


@pytest.mark.parametrize(("policy", "directed"), [("star", False), ("list", True), ("matrix", False)])
def test_bfs_by_levels_is_the_same(spark, policy, directed):
    edges = random_edges(7, 14, 22)
    g = graph(spark, edges, 14, directed, policy)
    expected = plain_bfs(ordered(edges, 14, directed, policy), 3)
    assert rows(traverse.bfs(g, 3, small=0), "v", "dist", "parent", "ord") == expected
    assert rows(traverse.distances(g, 3), "v", "dist") == [x[:2] for x in expected]


def test_demo_graph(spark):
    g = graph(spark, DEMO, 9, False)
    found = rows(traverse.bfs(g, 0), "ord", "v", "dist", "parent")
    assert [x[1] for x in found] == list(range(9))
    assert [x[2] for x in found] == [0, 1, 1, 2, 2, 3, 4, 5, 6]
    assert [x[3] for x in found] == [-1, 0, 0, 1, 2, 3, 5, 6, 7]
    assert dict(rows(traverse.paths(traverse.bfs(g, 0)), "v", "path"))[7] == "0 -> 1 -> 3 -> 5 -> 6 -> 7"
    tree = {(0, 1), (2, 3), (4, 5), (5, 6), (1, 3), (3, 5), (6, 7), (7, 8)}
    for small in (0, 100):
        forest = order.minimum_spanning_forest(g, small=small)
        assert {tuple(x) for x in rows(forest, "src", "dst")} == tree
        assert sum(x[0] for x in rows(forest, "w")) == 16.5
    assert {tuple(x) for x in rows(order.prim(g, 4), "src", "dst")} == tree
    assert [x[1] for x in rows(order.sort_edges(g.edges), "rank", "w")] == [1, 1, 1, 1, 1.5, 2, 2, 3, 4, 5]


def test_policy_changes_parents(spark):
    edges = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)]
    star = rows(traverse.bfs(graph(spark, edges, 4, True), 0), "ord", "v", "parent")
    listed = rows(traverse.bfs(graph(spark, edges, 4, True, "list"), 0), "ord", "v", "parent")
    assert [x[1] for x in star] == [0, 1, 2, 3] and star[3][2] == 1
    assert [x[1] for x in listed] == [0, 2, 1, 3] and listed[3][2] == 2


def test_construction(spark):
    for bad in ({"n": 0}, {"n": -1}, {"n": 3, "policy": "star"}, {"n": 3, "policy": "tree"}):
        with pytest.raises(InvalidArgument):
            Graph.create(spark, directed=True, **bad)
    for w in (0.0, -0.0):
        with pytest.raises(InvalidArgument):
            graph(spark, [(0, 1, 1), (1, 2, w)], 3, True)
    with pytest.raises(InvalidArgument):
        graph(spark, [(0, 3, 1)], 3, True)
    empty = graph(spark, [], 3, True)
    assert empty.count_edges() == 0 and rows(adj.out_degrees(empty), "id", "degree") == [(0, 0), (1, 0), (2, 0)]
    assert rows(adj.counts(empty), "n", "m", "arcs", "loops") == [(3, 0, 0, 0)]


def test_mutation(spark):
    g = Graph.create(spark, 4, True).add_edge(0, 1, 2.0).add_edge(0, 2, 3.0)
    assert [v for v, _ in adj.iter_out(g, 0)] == [2, 1]
    again = g.add_edge(0, 1, 5.0)
    assert [x for x in adj.iter_out(again, 0)] == [(2, 3.0), (1, 5.0)] and again.count_edges() == 2
    back = g.remove_edge(0, 1).add_edge(0, 1, 7.0)
    assert [v for v, _ in adj.iter_out(back, 0)] == [1, 2]
    assert g.remove_edge(3, 2).count_edges() == 2
    both = Graph.create(spark, 3, False).add_edge(0, 1, 2.0).add_edge(1, 0, 3.0)
    assert both.count_edges() == 1 and adj.get_weight(both, 0, 1) == adj.get_weight(both, 1, 0) == 3.0
    loop = Graph.create(spark, 3, False, "matrix").add_edge(2, 2, 1.0)
    assert adj.out_degree(loop, 2) == adj.in_degree(loop, 2) == 1
    star = graph(spark, [(0, 1, 2), (0, 1, 5)], 2, True)
    assert star.count_edges() == 2 and adj.out_degree(star, 0) == 2 and adj.get_weight(star, 0, 1) == 2.0
    with pytest.raises(ImmutableGraph):
        star.add_edge(0, 1, 1.0)
    with pytest.raises(ImmutableGraph):
        star.remove_edge(0, 1)
    with pytest.raises(InvalidArgument):
        star.add_edge(0, 2, 1.0)
    with pytest.raises(InvalidArgument):
        g.add_edge(0, 1, 0.0)
    assert adj.get_weight(star, 0, 9) == 0.0 and not adj.has_edge(star, 1, 0) and adj.has_edge(star, 0, 1)
    merged = star.with_policy("list")
    assert merged.count_edges() == 1 and adj.get_weight(merged, 0, 1) == 5.0


def test_operation_log_against_replay(spark):
    r = random.Random(5)
    log = [(i, r.choice(["add", "add", "remove"]), r.randrange(4), r.randrange(4), float(r.randint(1, 9))) for i in range(60)]
    for directed in (True, False):
        kept = {}
        for i, kind, u, v, w in log:
            key = (u, v) if directed else (min(u, v), max(u, v))
            if kind == "remove":
                kept.pop(key, None)
            else:
                kept[key] = (kept.get(key, (i,))[0], w)
        g = Graph.from_operations(spark.createDataFrame(log, OPERATIONS), 4, directed)
        assert rows(g.edges, "src", "dst", "eid", "w") == sorted((u, v, i, w) for (u, v), (i, w) in kept.items())


def test_neighbours_in(spark):
    edges = [(2, 0, 1), (1, 0, 2), (3, 0, 3)]
    assert [u for u, _ in adj.iter_in(graph(spark, edges, 4, True), 0)] == [2, 1, 3]
    assert [u for u, _ in adj.iter_in(graph(spark, edges, 4, True, "list"), 0)] == [1, 2, 3]
    assert [u for u, _ in adj.iter_in(graph(spark, edges, 4, False, "list"), 0)] == [3, 1, 2]
    with pytest.raises(InvalidArgument):
        adj.iter_in(graph(spark, edges, 4, True), 4)
    assert rows(adj.csr_offsets(graph(spark, edges, 4, True)), "id", "head") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]
    dense = dict(((u, v), w) for u, v, w in rows(adj.dense(graph(spark, edges, 4, True, "matrix")), "u", "v", "w"))
    assert len(dense) == 16 and dense[3, 0] == 3.0 and dense[0, 3] == 0.0


def test_sorting(spark):
    edges = graph(spark, [(0, 1, 2), (0, 1, 5), (0, 1, 1)], 2, True).edges
    assert [x[1] for x in rows(order.sort_edges(edges), "rank", "w")] == [1, 2, 5]
    part = graph(spark, [(0, 1, w) for w in (9, 8, 7, 6, 5)], 2, True).edges
    assert [x[1] for x in rows(order.sort_range(part, 1, 3), "rank", "w")] == [9, 6, 7, 8, 5]
    assert [x[1] for x in rows(order.least_edges(part, 2), "rank", "w")] == [5, 6]
    for p, q in ((0, 5), (-1, 2)):
        with pytest.raises(InvalidArgument):
            order.sort_range(part, p, q)
    with pytest.raises(InvalidArgument):
        order.minimum_spanning_forest(graph(spark, [(0, 1, 1)], 2, True))


def test_batch_keys(spark):
    keys = spark.createDataFrame([(5,), (3,), (8,)], "k long")
    least, rest = order.extract_min(keys, 2)
    assert rows(least, "k") == [(3,), (5,)] and rows(rest, "k") == [(8,)]
    assert rows(order.decrease_key(keys, 8, 2), "k") == [(3,), (5,), (6,)]
    for key, delta in ((8, 3), (8, 9), (7, 1), (8, -1)):
        with pytest.raises(InvalidArgument):
            order.decrease_key(keys, key, delta)
    for new in (-1, 5):
        with pytest.raises(InvalidArgument):
            order.insert_keys(keys, spark.createDataFrame([(new,)], "k long"))


def test_random_forests(spark):
    for seed in range(2):
        edges = random_edges(seed, 20, 35)
        up = list(range(20))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        expected = set()
        for i, (u, v, _) in sorted(enumerate(edges), key=lambda x: (x[1][2], x[0])):
            if root(u) != root(v):
                up[root(u)] = root(v)
                expected.add((i,))
        g = graph(spark, edges, 20, False)
        assert set(rows(order.minimum_spanning_forest(g, small=0), "eid")) == expected == set(rows(order.minimum_spanning_forest(g), "eid"))
        least = {x: min(y for y in range(20) if root(y) == root(x)) for x in range(20)}
        assert dict(rows(analytics.components(g), "v", "component")) == least


def test_shortest_paths(spark):
    g = graph(spark, [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, -1)], 5, True)
    assert dict(rows(analytics.shortest_paths(g, 0).where("distance is not null"), "v", "distance")) == {0: 0, 1: 3, 2: 1, 3: 2}
    with pytest.raises(InvalidArgument):
        analytics.shortest_paths(graph(spark, [(0, 1, 1), (1, 0, -2)], 2, True), 0)


def test_pagerank_sums_to_one(spark):
    g = graph(spark, random_edges(3, 10, 15), 10, True)
    assert abs(sum(x[0] for x in rows(analytics.pagerank(g, 4), "rank")) - 1) < 1e-9


def test_hubs_are_not_dealt(spark):
    arcs = spark.createDataFrame([(0, v) for v in range(50)] + [(u, u + 1) for u in range(1, 40)], "u long, v long")
    dealt = Dealt(arcs, "u", hub_rows=20)
    assert dealt.hubs == [0] and dealt.light.where("u = 0").isEmpty() and dealt.heavy.count() == 50
    other = spark.createDataFrame([(0, "a"), (3, "b"), (99, "c")], "u long, x string")
    assert rows(dealt.joined(other), "u", "x", "v") == [(0, "a", v) for v in range(50)] + [(3, "b", 4)]
    assert Dealt(arcs, "u").heavy is None
    assert Dealt(arcs.where("false"), "u").joined(other).isEmpty()


def test_ranks_of_groups_split_over_ranges(spark):
    pairs = [(g, x) for g, n in ((1, 1), (2, 400), (3, 3), (7, 150), (9, 1)) for x in range(n)]
    random.Random(1).shuffle(pairs)
    ranked = with_rank(spark.createDataFrame(pairs, "g long, x long").repartition(3), "rank", "g", "x")
    assert all(x == r for x, r in rows(ranked, "x", "rank")) and rows(ranked, "g", "x") == sorted(pairs)
    assert with_rank(spark.createDataFrame([], "g long, x long"), "rank", "g", "x").isEmpty()


def test_stars_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(5, 5), (80, 90), (90, 85), (80, 85), (80, 90)]
    found = stars(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert rows(found, "a", "b") == [(i, 10) for i in range(11, 61)] + [(85, 80), (90, 80)]
    assert stars(spark.createDataFrame([(5, 5)], "a long, b long")).isEmpty()


def test_local_forests_and_thinning_keep_the_forest(spark, monkeypatch):
    monkeypatch.setattr(order, "CHUNK", 40)
    edges = random_edges(4, 12, 150)
    g = graph(spark, edges, 12, False)
    expected = rows(order.minimum_spanning_forest(g), "eid")
    fewer = order.thinned(g.edges.where("src <> dst"), 0)
    assert set(expected) <= set(rows(fewer, "eid")) and fewer.count() < 75
    assert rows(order.minimum_spanning_forest(g, small=0), "eid") == expected == rows(order.minimum_spanning_forest(g, small=20), "eid")


def test_rounds_take_no_constraints_along(spark):
    edges = [(i, i + 1, float((i * 37) % 64 + 1)) for i in range(64)]
    forest = order.minimum_spanning_forest(graph(spark, edges, 65, False), small=0)
    assert len(forest._jdf.queryExecution().optimizedPlan().constraints().toSeq().toString()) < 2000
    deep = order.prim(graph(spark, [*edges, (70, 71, 1.0)], 72, False), 64)
    assert rows(deep, "eid") == [(i,) for i in range(64)] and order.prim(graph(spark, edges, 66, False), 65).isEmpty()


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_traversals_however_levels_are_joined(spark, monkeypatch, few):
    monkeypatch.setattr(loops, "FEW", few)
    monkeypatch.setattr(loops, "TASK_ROWS", 10)
    edges = random_edges(9, 14, 40)
    g = graph(spark, edges, 15, False)
    expected = plain_bfs(ordered(edges, 15, False, "star"), 2)
    assert rows(traverse.bfs(g, 2, small=0), "v", "dist", "parent", "ord") == expected
    assert rows(traverse.distances(g, 2), "v", "dist") == [x[:2] for x in expected]
    assert abs(sum(x[0] for x in rows(analytics.pagerank(g, 2), "rank")) - 1) < 1e-9


def test_depth_first_arcs_take_four_bytes():
    r = random.Random(3)
    out = [[r.randrange(50) for _ in range(r.randrange(40))] for _ in range(50)]
    arcs = [(u, v) for u in range(50) for v in out[u]]
    placed = list(enumerate(arcs))
    r.shuffle(placed)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(k, u, v) for k, (u, v) in placed[at : at + 64]], strict=True)], names=["place", "u", "v"]) for at in range(0, len(placed), 64)]
    head, to = traverse.packed(batches, 50)
    assert to.itemsize == 4 and to[: len(arcs)].tolist() == [v for _, v in arcs]
    found = zip(*(c.tolist() for c in traverse.walk_depths(head, to, 0)), strict=True)
    reached = {v: (dist, parent, k) for k, (v, dist, parent) in enumerate(found)}
    assert sorted((v, *reached.get(v, (-1, -1, -1))) for v in range(50)) == plain_dfs(out, 0)


def test_groups_are_dealt_to_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(loops, "TASK_BYTES", 500)
    log = loops.kept(spark.range(5000).selectExpr("id as seq", "'add' as kind", "id % 97 as u", "id % 89 as v", "1.0D as w").repartition(1))
    assert 20 < loops.tasks_for(log) < 1000
    for edges in (Graph.from_operations(log, 100, True).edges, Graph.from_edges(log.selectExpr("seq as eid", "u as src", "v as dst", "w"), 100, False).with_policy("list").edges):
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert max(int(x) for x in re.findall(r"hashpartitioning\(src#\d+L?, dst#\d+L?, (\d+)\)", plan)) > 20
