"""DOT text in and out."""

import pytest

from lattica.errors import InvalidArgument
from lattica.operators import traverse
from lattica.plans.model import EDGES, Graph
from lattica.sources import dot

BIG = 2**32
CASES = [
    ("digraph G {\n1 -> 2;\n}", True, 3, [(1, 2)]),
    ("graph G {\n1 -- 2;\n}", False, 3, [(1, 2)]),
    ("1 -- 2\n2 -> 3", False, 4, [(1, 2), (2, 3)]),
    ("1 --> 2", False, 2, []),
    ("strict digraph G {\n1 -> 2\n1 -> 2", True, 3, [(1, 2), (1, 2)]),
    ("1 -> 2 -> 3 [x=1];", True, 4, [(1, 2), (2, 3)]),
    ("1 -> 2; 3 -> 4;", True, 3, [(1, 2)]),
    ("{ 1 -> 2\n7;", True, 8, []),
    ("digraph {\ngraph [a=b];\n1 -> 2;", False, 3, [(1, 2)]),
    ("7;", True, 8, []),
    (f"1 -> {BIG}", True, 2, []),
    (f"{BIG} -> 1\n3", True, 4, []),
    (f"{BIG} -- 1\n3 -> 4", True, 5, [(3, 4)]),
    ("1 -> 99999999999999999999999999999999999999999999 -> 2", True, 2, []),
    ("12abc -> 3", True, 13, []),
    ("1->2\r\n\t2 ->3\r", True, 4, [(1, 2), (2, 3)]),
    ("-5 -> 1\na -> b\n\"1\" -> \"2\"\n% 1 -> 9\n# 1 -> 9\n// 1 -> 9\n\n/* x */ 1 -> 9\n3 -> 3", True, 4, [(3, 3)]),
    ("1 -> 2 -- 3", True, 4, [(1, 2), (2, 3)]),
    ("1 -> 2" + " " * 1020 + "-> 3", True, 3, [(1, 2)]),
]


@pytest.mark.parametrize(("text", "directed", "n", "edges"), CASES)
def test_reading(spark, text, directed, n, edges):
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")
    g = dot.parse_dot(lines)
    assert (g.directed, g.n) == (directed, n)
    assert [(r.src, r.dst) for r in g.edges.orderBy("eid").collect()] == edges


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "one").write_text("digraph G { 1 -> 2; }")
    for name in ("one", "none"):
        with pytest.raises(InvalidArgument):
            dot.read_dot(spark, str(tmp_path / name))


def test_writing_and_reading_again(spark, tmp_path):
    edges = spark.createDataFrame([(0, 0, 1, 1.5), (1, 1, 2, 0.00001), (2, 2, 2, 1234567.0), (3, 3, 1, 1.0)], EDGES)
    g = Graph.from_edges(edges, 5, False)
    path = str(tmp_path / "g.dot")
    dot.write_dot(g, path, traverse.bfs(g, 0))
    expected = [
        "graph G {", "  rankdir=LR;", "  node [shape=circle, style=filled, fillcolor=white];", "",
        '  0 [label="0\\nd=0", fillcolor=orange];', '  1 [label="1\\nd=1", fillcolor=lightblue];', '  2 [label="2\\nd=2", fillcolor=lightblue];',
        '  3 [label="3\\nd=2", fillcolor=lightblue];', "  4;", "",
        '  0 -- 1 [label="1.5", color=red, penwidth=2.0];', '  1 -- 2 [label="1e-05", color=red, penwidth=2.0];',
        '  1 -- 3 [label="1", color=red, penwidth=2.0];', '  2 -- 2 [label="1.23457e+06", color=gray50];', "}", "",
    ]
    assert open(path).read().split("\n") == expected
    back = dot.read_dot(spark, path)
    assert (back.n, back.directed, back.count_edges()) == (5, False, 4)
    with pytest.raises(InvalidArgument):
        dot.write_dot(g, path, traverse.bfs(g, 0).limit(2))
    with pytest.raises(InvalidArgument):
        dot.write_dot(g, str(tmp_path / "no" / "g.dot"))


def test_plain_directed_writing(spark, tmp_path):
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 0, 2.0), (1, 1, 0, 3.0)], EDGES), 2, True)
    dot.write_dot(g, str(tmp_path / "g"))
    assert open(tmp_path / "g").read().split("\n")[4:] == ["  0;", "  1;", "", '  1 -> 0 [label="2", color=gray50];', '  1 -> 0 [label="3", color=gray50];', "}", ""]


def test_lines_of_a_split_file_keep_their_numbers(spark, tmp_path):
    expected = [f"{k} -> {k + 1}\r" if k % 3 else "" for k in range(5000)]
    text = spark.createDataFrame([*enumerate(expected)], "line_no long, line string")
    dot.write_lines(text.repartition(5), f"{tmp_path}/a.dot")
    assert (tmp_path / "a.dot").read_bytes() == "".join(f"{x}\n" for x in expected).encode()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = dot.read_lines(spark, f"{tmp_path}/a.dot")
        assert lines.rdd.getNumPartitions() >= 1 and sorted(map(tuple, lines.collect())) == [*enumerate(expected)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
