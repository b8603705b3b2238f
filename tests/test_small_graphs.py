"""Queries on many small graphs take one shuffle and no rounds, with the rows that rounds give."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graphs, small_graphs


def fail(*_):
    raise AssertionError("rounds over small graphs")


@pytest.fixture
def edges(spark):
    draw = random.Random(5)
    rows = {(g, f"n{draw.randrange(3 + g % 6)}", f"n{draw.randrange(3 + g % 6)}") for g in range(60) for _ in range(2 + g % 9)}
    rows |= {(g, a, b) for g, a, b in rows if a < b and g % 4 == 0}
    return spark.createDataFrame(sorted(r for r in rows if r[0] % 4 or r[1] < r[2]), "graph_id int, src string, dst string")


def both_ways(monkeypatch, rounds, query):
    """Rows of ``query`` where ``rounds`` must not run, and where every graph goes through rounds."""
    rows = lambda: sorted(map(repr, query().collect()))
    with monkeypatch.context() as m:
        m.setattr(graphs, rounds, fail)
        small = rows()
    monkeypatch.setattr(small_graphs, "SMALL", 0)
    assert small and small == rows()


@pytest.mark.parametrize("steps", [2, 8])
def test_sample_walk(monkeypatch, edges, steps):
    both_ways(monkeypatch, "topological_order", lambda: graphs.sample_walk(edges, steps))


def test_walk_sequence(monkeypatch, edges):
    parts = graphs.edge_nodes(edges).withColumn("sequence", F.md5("node"))
    both_ways(monkeypatch, "topological_order", lambda: graphs.walk_sequence(graphs.sample_walk(edges), parts))


def test_walk_sequence_reads_its_walk_once(spark, edges):
    walk = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "graph_id int, pos int, node string")
    parts = spark.createDataFrame([(1, "a", "AC"), (1, "b", "GG"), (1, "c", "T")], "graph_id int, node string, sequence string")
    out = graphs.walk_sequence(walk, parts)
    assert {tuple(r) for r in out.collect()} == {(1, "ACNGGT"), (2, "A")}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_representative_nodes(monkeypatch, edges):
    both_ways(monkeypatch, "topological_order", lambda: graphs.representative_nodes(edges, 4, 2))


def test_representative_nodes_by_more_hubs(monkeypatch, edges):
    both_ways(monkeypatch, "topological_order", lambda: graphs.representative_nodes(edges, 5, 3))


def test_context_snapshot(monkeypatch, edges):
    both_ways(monkeypatch, "topological_order", lambda: graphs.context_snapshot(edges, 4, 2))


def test_graph_stats(spark, monkeypatch, edges):
    alone = spark.createDataFrame([(1, "z"), (99, "a"), (99, "b")], "graph_id int, node string")
    both_ways(monkeypatch, "weak_components", lambda: graphs.graph_stats(graphs.edge_nodes(edges).unionByName(alone), edges))
