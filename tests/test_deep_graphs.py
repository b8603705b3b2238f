"""Graph loops on deep graphs: rounds must not follow depth, results equal plain searches."""

import random
from collections import deque

import pytest

from strandloom.operators import graphs, loops, small_graphs, splice

SCHEMA = "graph_id int, src int, dst int"


def searched(edges, source):
    after, seen, queue = {}, {source: 0}, deque([source])
    for a, b in edges:
        after.setdefault(a, []).append(b)
    while queue:
        a = queue.popleft()
        for b in after.get(a, ()):
            if b not in seen:
                seen[b] = seen[a] + 1
                queue.append(b)
    return seen


def shapes():
    """Edges of graphs: random ones, paths, bubbles in rows, pure circles, circles on paths."""
    rnd = random.Random(21)
    for n, m in ((6, 7), (12, 16), (15, 40), (14, 14)):
        yield {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
    yield {(i, i + 1) for i in range(30)}
    yield {e for i in range(0, 30, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))}
    yield {(i, (i + 1) % 17) for i in range(17)}
    yield {(i, i + 1) for i in range(25)} | {(12, 5), (25, 20), (3, 3)}
    order = list(range(20))
    rnd.shuffle(order)
    yield set(zip(order, order[1:], strict=False)) | {(order[19], order[10])}


@pytest.fixture(scope="module")
def world(spark):
    graphs_of = dict(enumerate(shapes()))
    return graphs_of, spark.createDataFrame([(g, a, b) for g, es in graphs_of.items() for a, b in es], SCHEMA)


def strong(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set(searched(edges, n)) for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("small", [0, 2000])
def test_strong_components(world, monkeypatch, small):
    monkeypatch.setattr(small_graphs, "SMALL", small)
    got = {(r["graph_id"], r["node"]): r["scc"] for r in graphs.strong_components(world[1]).collect()}
    assert got == {(g, n): c for g, es in world[0].items() for n, c in strong(es).items()}


def test_rounds_end_where_a_task_can_hold_the_rest(world, monkeypatch):
    monkeypatch.setattr(small_graphs, "SMALL", 1)
    monkeypatch.setattr(small_graphs, "LINEAR", 12)
    got = {(r["graph_id"], r["node"]): r["scc"] for r in graphs.strong_components(world[1]).collect()}
    assert got == {(g, n): c for g, es in world[0].items() for n, c in strong(es).items()}


def test_paths_are_spliced_before_circles_are_looked_for(spark, monkeypatch):
    """A circle of 300 nodes with three ways round a part of it, too large for a task until its paths are edges."""
    edges = [(1, i, (i + 1) % 300) for i in range(300)] + [(1, 0, 300), (1, 300, 301), (1, 301, 40), (1, 100, 302), (1, 302, 180), (1, 302, 303)]
    monkeypatch.setattr(small_graphs, "SMALL", 1)
    monkeypatch.setattr(small_graphs, "LINEAR", 12)
    monkeypatch.setattr(graphs, "_pointer_circles", None)
    got = {r["node"]: r["scc"] for r in graphs.strong_components(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert got == {n: 0 for n in range(303)} | {303: 303}


def test_a_few_thousand_edges_take_no_rounds(spark, monkeypatch):
    """Layers of four nodes, each joined with all of the next, and one edge back: nothing to splice, a layer a round."""
    edges = [(g, 4 * i + a, 4 * i + 4 + b) for g in (1, 2) for i in range(200) for a in range(4) for b in range(4)] + [(1, 799, 0)]
    monkeypatch.setattr(graphs, "_pointer_circles", None)
    rows = graphs.strong_components(spark.createDataFrame(edges, SCHEMA)).collect()
    on = {r["node"] for r in rows if r["graph_id"] == 1 and r["scc"] == 0}
    assert on == {0, *range(4, 796), 799} and all(r["scc"] == r["node"] for r in rows if r["graph_id"] == 2 or r["node"] not in on)


@pytest.mark.parametrize(("limit", "small"), [(None, 12), (40, 0)])
def test_hops_of_contracted_graphs(world, monkeypatch, limit, small):
    monkeypatch.setattr(graphs, "SHALLOW", 1)
    monkeypatch.setattr(small_graphs, "SMALL", small)
    every = {(r["graph_id"], r["src"], r["dst"]): r["hops"] for r in graphs.hop_distance(world[1], max_hops=limit).collect()}
    want = {(g, s, t): h for g, es in world[0].items() for s in {x for e in es for x in e} for t, h in searched(es, s).items()}
    assert every == want


def test_hops_from_sources(world, spark, monkeypatch):
    monkeypatch.setattr(graphs, "SHALLOW", 1)
    picks = [(g, n) for g, es in world[0].items() for n in sorted({x for e in es for x in e})[1:9:3]]
    got = {(r["graph_id"], r["src"], r["dst"]): r["hops"] for r in graphs.hop_distance(world[1], spark.createDataFrame(picks, "graph_id int, node int")).collect()}
    assert got == {(g, s, t): h for g, s in picks for t, h in searched(world[0][g], s).items()}


def test_layers_of_contracted_graphs(world, monkeypatch):
    monkeypatch.setattr(graphs, "SHALLOW", 2)
    got = {(r["graph_id"], r["node"]): (r["layer"], r["is_dag"]) for r in graphs.topological_order(world[1]).collect()}
    for g, es in world[0].items():
        nodes = {x for e in es for x in e}
        dag = all(a != b for a, b in es) and len(set(strong(es).values())) == len(nodes)
        layer = dict.fromkeys(nodes, 0)
        for _ in nodes if dag else ():
            for a, b in es:
                layer[b] = max(layer[b], layer[a] + 1)
        assert {n: got[g, n] for n in nodes} == {n: (layer[n], dag) for n in nodes}


def test_shortest_paths_are_the_least_by_names(world, spark):
    pairs = [(g, s, t) for g, es in world[0].items() for s in {x for e in es for x in e} for t in {x for e in es for x in e} if (s * 7 + t) % 5 == 0]
    got = {(r["graph_id"], r["src"], r["dst"]): r["path"] for r in graphs.shortest_paths(world[1], spark.createDataFrame(pairs, SCHEMA)).collect()}
    want = {}
    for g, s, t in pairs:
        es = world[0][g]
        away = searched([(b, a) for a, b in es], t)
        if s in away:
            path = [s]
            while path[-1] != t:
                path.append(min(b for a, b in es if a == path[-1] and away.get(b) == away[path[-1]] - 1))
            want[g, s, t] = path
    assert got == want


@pytest.fixture
def jobs(monkeypatch):
    """How many tables the loops have written."""
    seen, plain, cut = [], loops.Scratch.put, graphs.cut
    monkeypatch.setattr(loops.Scratch, "put", lambda self, df, label: seen.append(label) or plain(self, df, label))
    monkeypatch.setattr(graphs, "cut", lambda df: seen.append("cut") or cut(df))
    return seen


def test_a_chain_of_a_thousand_circles(spark, jobs):
    """Components whose names rise along the edges: rounds must not follow their number."""
    edges = [e for i in range(0, 2000, 2) for e in ((1, i, i + 1), (1, i + 1, i), (1, i + 1, i + 2))][:-1]
    got = graphs.strong_components(spark.createDataFrame(edges, SCHEMA)).collect()
    assert {r["node"]: r["scc"] for r in got} == {n: n - n % 2 for n in range(2000)}
    assert len(jobs) < 120


def test_deep_paths_in_few_rounds(spark, jobs):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(3000)], SCHEMA)
    start = spark.createDataFrame([(1, 0)], "graph_id int, node int")
    assert {(r["dst"], r["hops"]) for r in graphs.hop_distance(edges, start).collect()} == {(i, i) for i in range(3001)}
    assert {(r["node"], r["layer"]) for r in graphs.topological_order(edges).collect()} == {(i, i) for i in range(3001)}
    assert len(jobs) < 160


def test_splicing_keeps_distances(spark):
    work = loops.Scratch(spark)
    rows = [(1, i, i + 1, 1) for i in range(9)] + [(1, 0, 20, 1), (1, 20, 9, 1), (1, 9, 10, 1)]
    taken, left = splice.levels(spark.createDataFrame(rows, SCHEMA + ", weight long"), work)
    assert [(r["src"], r["dst"], r["weight"]) for r in left.collect()] == [(0, 10, 3)] and len(taken) == 2
