import pytest
from pyspark.sql import functions as F

from strandloom.operators import chaining, graphs

LINKS = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "c"), ("a", "c")]


@pytest.fixture(scope="module")
def links(spark):
    rows = [(g, a, b, "+", "-" if i == 5 else "+", i) for g in (1, 2) for i, (a, b) in enumerate(LINKS)]
    return spark.createDataFrame(rows, "graph_id int, src string, dst string, src_orient string, dst_orient string, line_no int")


@pytest.fixture(scope="module")
def edges(links):
    return graphs.simple_edges(links)


def of(df, *cols):
    return sorted(tuple(r) for r in df.where("graph_id = 1").select(*cols).collect())


def test_edges(edges):
    assert edges.where("graph_id = 1").count() == 5
    assert of(edges.where("src = 'a' and dst = 'c'"), "dst_orient") == [("-",)]


def test_degree(edges):
    assert of(graphs.degrees(edges), "node", "in_degree", "out_degree") == [("a", 0, 2), ("b", 2, 1), ("c", 2, 2), ("d", 1, 0)]


def test_components(edges):
    assert {c for _, c in of(graphs.weak_components(edges), "node", "component")} == {"a"}
    assert of(graphs.strong_components(edges), "node", "scc") == [("a", "a"), ("b", "b"), ("c", "b"), ("d", "d")]
    assert of(graphs.cyclic_nodes(graphs.strong_components(edges), edges), "node") == [("b",), ("c",)]
    assert of(graphs.has_cycle(edges), "has_cycle") == [(True,)]


def test_reach(edges):
    want = {"a": "abcd", "b": "bcd", "c": "bcd", "d": "d"}
    assert of(graphs.reachability(edges), "src", "dst") == sorted((s, t) for s, ts in want.items() for t in ts)
    hops = dict(((s, t), h) for s, t, h in of(graphs.hop_distance(edges), "src", "dst", "hops"))
    assert {k: v for k, v in hops.items() if v} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("b", "c"): 1, ("b", "d"): 2, ("c", "b"): 1, ("c", "d"): 1}


def test_stats(edges):
    r = graphs.graph_stats(graphs.edge_nodes(edges), edges).where("graph_id = 1").first()
    assert (r["nodes"], r["edges"], r["wcc"], r["scc"], r["largest_scc"], r["self_loops"], r["has_cycle"]) == (4, 5, 1, 3, 2, 0, True)


def test_dag_and_cover(edges):
    assert of(graphs.back_edges(edges), "src", "dst") == [("c", "b")]
    dag = graphs.to_dag(edges)
    assert of(dag, "src", "dst") == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]
    assert of(graphs.topological_order(dag), "layer", "node") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    cover = graphs.path_cover(dag)
    assert of(cover, "path", "step", "node") == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d")]
    assert graphs.covers(cover, graphs.edge_nodes(dag))


def test_cycles_walks_and_parts(edges):
    dag = graphs.to_dag(edges)
    added = graphs.add_cycles(dag).where("synthetic")
    assert of(added, "src", "dst") == [("c", "a"), ("d", "b")]
    assert of(graphs.sample_walk(edges), "pos", "node") == [(0, "b"), (1, "c"), (2, "b")]
    assert of(graphs.sample_walk(dag), "pos", "node") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert len(of(graphs.representative_subgraph(edges, 3), "src", "dst")) >= 2
    assert {r[0]: r[1] for r in of(graphs.context_snapshot(edges), "stage", "nodes")} == {"original": 4, "representative": 4, "cyclic": 4}


@pytest.fixture(scope="module")
def chain(spark, edges):
    rows = [("A1", "a", 1, 4, 1, 4, 4), ("N1", "d", 1, 2, 3, 4, 3), ("A2", "b", 1, 3, 5, 7, 3), ("A3", "c", 1, 5, 9, 13, 5), ("A4", "b", 1, 3, 14, 16, 3)]
    anchors = spark.createDataFrame([("q", *r) for r in rows], "query_id string, anchor_id string, vertex string, x int, y int, c int, d int, weight int")
    g = edges.where("graph_id = 1")
    hops = graphs.hop_distance(g).drop("graph_id")
    loops = graphs.cyclic_nodes(graphs.strong_components(g), g).select("node")
    lengths = spark.createDataFrame([("a", 4), ("b", 3), ("c", 5), ("d", 2)], "node string, length int")
    return anchors, chaining.gap_cost(chaining.precedes(anchors, hops, loops), hops, lengths)


def test_precedence_and_gaps(chain):
    got = {(r["left_id"], r["right_id"]): r["gap"] for r in chain[1].collect()}
    assert got == {("A1", "A2"): 1, ("A1", "A3"): 5, ("A1", "A4"): 10, ("A2", "A3"): 2, ("A2", "A4"): 6, ("A3", "A4"): 1}


def test_chain(chain):
    anchors, pairs = chain
    scores = chaining.chain_scores(anchors, pairs)
    assert {r["anchor_id"]: r["score"] for r in scores.collect()} == {"A1": 4, "N1": 3, "A2": 6, "A3": 9, "A4": 11}
    best = chaining.best_chain(scores)
    assert [r["anchor_id"] for r in best.orderBy("pos").collect()] == ["A1", "A2", "A3", "A4"]
    assert best.first()["chain_score"] == 11
    assert [r["gap"] for r in chaining.chain_gaps(best, pairs).orderBy("pos").collect()] == [1, 2, 1]
    rounds = chaining.convergence(chaining.chain_iterate(anchors, pairs)).orderBy("iter").collect()
    assert [r["best_score"] for r in rounds] == [5, 7, 9, 11]


def test_walk_anchors(spark):
    walk = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "c")], "query_id string, pos int, node string")
    lengths = spark.createDataFrame([("q", "a", 4), ("q", "b", 30), ("q", "c", 5)], "query_id string, node string, length int")
    got = [(r["x"], r["y"], r["c"], r["d"]) for r in chaining.walk_anchors(walk, lengths).orderBy("pos").collect()]
    assert got == [(1, 4, 1, 4), (1, 8, 6, 13), (1, 5, 14, 18)]
    seq = spark.createDataFrame([(1, "a", "ACGT"), (1, "b", "G" * 30), (1, "c", "TTTTT")], "graph_id int, node string, sequence string")
    w = walk.select(F.lit(1).alias("graph_id"), "pos", "node")
    assert graphs.walk_sequence(w, seq).first()["sequence"] == "ACGTN" + "G" * 10 + "TTTTT"
