"""Connected components of a link table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch


def components(links: DataFrame, work: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v bigint): component is the smallest node reachable; a
    table of ``work``.

    A large star links a node's larger neighbours to its smallest one, a small star the smaller ones; both keep
    connectivity, and the table ends as one star a component after a number of rounds that grows with the
    logarithm of its size; more than ``max_rounds`` would be a fault, and raise an error.  A hub's neighbours meet
    its root in a join whose other side is a stored table of one row a node, so that a hub's partition can be split
    at run time.
    """
    edges = work.put(links.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi <> lo").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = work.put(both.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("root")), "least")
        large = work.put(both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("root").alias("lo")).distinct(), "large")
        roots = work.put(large.groupBy("hi").agg(F.min("lo").alias("root")), "roots")
        linked = large.join(roots, "hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).where("hi <> lo")
        new = work.put(linked.unionByName(roots.select("hi", F.col("root").alias("lo"))).distinct(), "edges")
        same = _sum(new) == _sum(edges)
        work.drop(edges, least, large, roots)
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = work.put(edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()), "components")
    work.drop(edges)
    return found


def _sum(edges: DataFrame):
    h = F.xxhash64("hi", "lo")
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_003).cast("bigint")).alias("s")).first()
    return r["n"], r["x"], r["s"]
